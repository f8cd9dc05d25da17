"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    chat,
    clusters,
    common,
    decontaminate,
    exact_dedup,
    importance,
    language,
    language_model,
    passages,
    sentences,
    shards,
    simhash,
    token_files,
    warc,
)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, which the operators take as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> str:
    return vocabulary("byte_bpe_50k.json")


def sentence_pieces() -> str:
    return vocabulary("piece_bpe_32k.model")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    common.ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo the folds; a NULL identifier is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = common.new_location(spark, "warc")
    index = warc.write_bundles(read(spark, sf_dir, "pages"), location, least_bytes=0)
    return warc.read_bundles(index, location).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of benchmark items in the documents."""
    return decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row_key")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.digests(read(spark, sf_dir, "documents"), sentence_pieces())


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.kd_shards(read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = common.new_location(spark, "tokens")
    index = token_files.write_tokens(read(spark, sf_dir, "documents"), location, byte_level(), end_id=0)
    return token_files.read_tokens(index, location)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = language.fit(documents, ~held_out)
    return language.predict(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score_texts(read(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose two texts are full of control strings."""
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    columns = ["conv_id", "turn", "role", "text"]
    turns = read(spark, sf_dir, "conversations").select(*columns).unionByName(added)
    return chat.conversation_digests(chat.chat_windows(turns))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroid_clusters(read(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundles": op1_warc_bundles,
    "op2_passages": op2_passages,
    "op3_decontaminate": op3_decontaminate,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_kd_shards": op6_kd_shards,
    "op7_token_files": op7_token_files,
    "op8_language_id": op8_language_id,
    "op9_language_model": op9_language_model,
    "op10_simhash": op10_simhash,
    "op11_chat_windows": op11_chat_windows,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_importance": op13_importance,
}

#: A digit of base 32 is five bits of the digest, written as 0 and 1.
_BASE32 = """
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
        + 16 * CAST(substr(bits, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS BIGINT)
        + 4 * CAST(substr(bits, 5 * i + 3, 1) AS BIGINT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS BIGINT)
        + CAST(substr(bits, 5 * i + 5, 1) AS BIGINT) AS BIGINT), 1)), 'string_agg', '')
"""


def _chat_sql() -> str:
    """Windows of turns by their prefix sums; only their lengths depend on the windows."""
    marks = len(chat.START) + len(chat.END) + 2
    room = f"floor(({chat.BUDGET - chat.HISTORY} - coalesce(system_tokens, 0)) / 2)"
    return rf"""
        WITH raw AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), written AS (
            SELECT *, floor(turn / {chat.BLOCK_TURNS}) AS block,
                   regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS etext,
                   replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A') AS erole
            FROM raw
        ), sized AS (
            SELECT *, ((octet_length(encode(etext)) + 3) // 4) + {chat.MARK_TOKENS} AS tokens,
                   length(erole) + length(etext) + {marks} AS chars
            FROM written
        ), heads AS (
            SELECT conv_id, held AS system, system_tokens, system_chars
            FROM (
                SELECT conv_id, tokens AS system_tokens, chars AS system_chars,
                       CASE WHEN erole = 'system' AND tokens <= {chat.BUDGET // 2} THEN etext END AS held,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, erole, held NULLS FIRST) AS i
                FROM sized
            ) WHERE i = 1 AND held IS NOT NULL
        ), summed AS (
            SELECT s.*, system, coalesce(system_chars, 0) AS system_chars, {room} AS room,
                   row_number() OVER (PARTITION BY s.conv_id ORDER BY turn NULLS FIRST, erole, etext) AS n,
                   sum(tokens) OVER spans - tokens AS before
            FROM sized s LEFT JOIN heads h ON s.conv_id IS NOT DISTINCT FROM h.conv_id
            WINDOW spans AS (PARTITION BY s.conv_id, block ORDER BY turn NULLS FIRST, erole, etext ROWS UNBOUNDED PRECEDING)
        ), slotted AS (
            SELECT *, floor(before / room) AS slot, tokens > room AS alone, n = 1 AND system IS NOT NULL AS is_head FROM summed
        ), begun AS (
            SELECT *, CASE WHEN lag(slot) OVER turns IS NULL OR lag(slot) OVER turns <> slot
                             OR lag(alone) OVER turns OR alone THEN 1 ELSE 0 END AS begins
            FROM slotted WINDOW turns AS (PARTITION BY conv_id, block ORDER BY n)
        ), spans AS (
            SELECT *, sum(begins) OVER (PARTITION BY conv_id, block ORDER BY n ROWS UNBOUNDED PRECEDING) AS span FROM begun
        ), tails AS (
            SELECT *, max(before + tokens) OVER (PARTITION BY conv_id, block, span) - before <= {chat.HISTORY} AND NOT is_head AS repeated
            FROM spans
        ), windows AS (
            SELECT conv_id, block, span, sum(chars) AS new_chars, coalesce(sum(chars) FILTER (WHERE repeated), 0) AS tail_chars,
                   CASE WHEN bool_or(is_head) THEN 0 ELSE any_value(system_chars) END AS system_chars
            FROM tails GROUP BY conv_id, block, span
        ), formatted AS (
            SELECT conv_id, sum(new_chars + system_chars + before_chars) AS formatted_chars
            FROM (
                SELECT *, coalesce(lag(tail_chars) OVER (PARTITION BY conv_id, block ORDER BY span), 0) AS before_chars FROM windows
            ) GROUP BY conv_id
        ), said AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, erole, etext) AS lines,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, erole, etext) FILTER (WHERE role = 'assistant'), '') AS learned
            FROM sized GROUP BY conv_id
        )
        SELECT s.conv_id, n_turns, sha256(lines) AS turns_sha256, length(learned) AS loss_chars,
               sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM said s JOIN formatted f ON s.conv_id IS NOT DISTINCT FROM f.conv_id
    """


def _cluster_sql() -> str:
    """The rounds one after the other; a mean's floor is taken in whole numbers."""
    # The round's place stands in for the table of centroids.
    assigned = """
        SELECT vec_id, v, arg_min(c, {{d: d, c: c}}) AS c, min(d) AS distance FROM (
            SELECT v.vec_id, v.v, v.row, c.c,
                   list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
            FROM vectors v, centroids{0} c
        ) GROUP BY row, vec_id, v
    """
    rounds = "".join(
        f"""
        , assigned{i} AS MATERIALIZED ({assigned.format(i)}), sums{i} AS (
            SELECT c, place, sum(x) AS s, count(*) AS n
            FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS place FROM assigned{i}) GROUP BY c, place
        ), means{i} AS (
            SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM sums{i} GROUP BY c
        ), centroids{i + 1} AS MATERIALIZED (
            SELECT o.c, coalesce(m.v, o.v) AS v FROM centroids{i} o LEFT JOIN means{i} m ON o.c = m.c
        )
        """
        for i in range(clusters.ROUNDS)
    )
    last = clusters.ROUNDS
    return f"""
        WITH vectors AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id,
                   list_transform(embedding, lambda x: CAST(floor({clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {clusters.DIMENSIONS}
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clusters.DIMENSIONS}
        ), centroids0 AS MATERIALIZED (
            SELECT CAST(i - 1 AS INTEGER) AS c, v FROM (
                SELECT v, row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS i
                FROM vectors
            ) WHERE i <= {clusters.CENTROIDS}
        ) {rounds}, assigned AS MATERIALIZED ({assigned.format(last)})
        SELECT vec_id, a.c AS cluster, CAST(distance AS BIGINT) AS distance,
               CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM assigned a JOIN centroids{last} c ON a.c = c.c
    """


def _importance_sql() -> str:
    """crc32 from the table of its 256 steps, over the bytes of the distinct words."""
    n = importance.BUCKETS
    return rf"""
        WITH steps AS (
            SELECT list(list_reduce([byte, 1, 1, 1, 1, 1, 1, 1, 1],
                lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY byte) AS step
            FROM (SELECT CAST(range AS BIGINT) AS byte FROM range(256))
        ), texts AS MATERIALIZED (
            SELECT 's' AS side, row_number() OVER () AS row, doc_id, text FROM documents
            UNION ALL SELECT 't', NULL, NULL, text FROM benchmark
        ), words AS MATERIALIZED (
            SELECT side, row, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM texts
        ), buckets AS MATERIALIZED (
            SELECT word, xor(list_reduce(
                list_transform(range(octet_length(encode(word))),
                    lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
                lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % {n} AS bucket
            FROM (SELECT DISTINCT word FROM words), steps
        ), totals AS (
            SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t
            FROM words JOIN buckets USING (word) GROUP BY bucket
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM totals) + {n} AS DOUBLE)
                / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM totals) + {n} AS DOUBLE)))) AS BIGINT) AS gain
            FROM totals
        ), weights AS (
            SELECT row, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
            FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY row
        ), scored AS (
            SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8) AS BIGINT)
                       + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM texts LEFT JOIN weights USING (row) WHERE side = 's'
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
            FROM scored WHERE n_features >= {importance.LEAST_WORDS}
        )
        SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= {importance.PERCENT} * n // 100 THEN rank END AS rank
        FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
    """


ORACLE_SQL: dict[str, str] = {
    "op11_chat_windows": _chat_sql(),
    "op12_centroid_clusters": _cluster_sql(),
    "op13_importance": _importance_sql(),
    "op1_warc_bundles": f"""
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS payload,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
            FROM pages
        ), digests AS (
            SELECT *, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits FROM payloads
        )
        SELECT page_id, octet_length(encode(payload)) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> owner THEN owner END AS refers_to
        FROM digests
    """,
    "op4_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        ), groups AS (
            SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM normal JOIN groups USING (t)
    """,
}
