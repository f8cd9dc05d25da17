"""Language-model scores from a log-frequency Bloom filter.

Words and word pairs are counted over all documents that may be learned from. A count c is quantised
to 1 + floor(log2 c) levels, and an n-gram of q levels is put into a Bloom filter q times, once with
each level; its count is found again by probing levels 1, 2, ... until one is missing. Probabilities
are interpolated from the probed counts of pair, history and word. The filter has ``bits_per_entry``
bits for each entry, however many there are: no n-gram is left out. It is never in one place. It
stays cut into segments by ranges of the n-gram's hash, one row each; blocks of texts send their
distinct n-grams to the segments, packed, and get their levels back.

Counts are gathered packed: a task counts its own n-grams, cuts them by ranges of their hash and
sends each range as one row, so a word that is in every text costs one entry a task.

The exact base score needs exact word counts, of any vocabulary. The most frequent words (at most
``head_words``, a bound) are broadcast; tokens that are not among them are rare by choice and are
joined with the counts of the rest, by word.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import col, flat, lower, mix, pieces, shuffle_parts, stage, word_hashes, word_spans
from .packed import bucket_of, by_bucket, pack, summed, unpack

#: The token after the last word of each text, and the history of its first.
END = np.uint64(0x5851F42D4C957F2D)
#: Tokens that a task counts before it sends them on, and bytes of text that are read at once.
FLUSH_TOKENS = 500_000
READ_BYTES = 1 << 19
#: Bytes of text in one block, whose distinct n-grams are probed together.
BLOCK_BYTES = 4 << 20
BITS_PER_ENTRY = 6
PROBES = 4
#: Buckets for each part of a shuffle: a task holds one bucket's n-grams, or a few blocks.
FINER = 2
HEAD_WORDS = 1 << 20
#: Weight of the pair's own frequency against the word's.
PAIR_WEIGHT = 0.6
SMOOTHING = 0.1
MAX_LEVELS = 40


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words with A-Z lower-cased, then END for each text), and tokens by text."""
    data, offsets = flat(texts)
    data = lower(data)
    starts, ends, first = word_spans(data, offsets)
    return np.insert(word_hashes(data, starts, ends), first[1:], END), np.diff(first) + 1


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """The key of each token with the one before; a text's first comes after END."""
    before = np.concatenate([[END], tokens[:-1]])
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def levels(counts: np.ndarray) -> np.ndarray:
    """How often an n-gram is in the filter: 1 + floor(log2 of its count)."""
    return np.frexp(counts.astype(np.float64))[1]


def _positions(keys: np.ndarray, level: int, probe: int, bits: np.ndarray) -> np.ndarray:
    """Which bit of its segment a probe looks at."""
    value = mix(keys + np.uint64(level * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
    step = (value >> np.uint64(32)) | np.uint64(1)
    return ((value & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * step) % bits


def segment_of(keys: np.ndarray, counts: np.ndarray, bits_per_entry: int) -> bytes:
    """The part of the filter for one bucket's n-grams, all of them."""
    level = levels(counts)
    size = int(level.sum() * bits_per_entry // 8 + 8)
    bits = np.zeros(size * 8, bool)
    of = np.full(1, size * 8, np.uint64)
    for n in range(1, int(level.max(initial=0)) + 1):
        chosen = keys[level >= n]
        for probe in range(PROBES):
            bits[_positions(chosen, n, probe, of)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def estimated(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level: 1, 2.5, 5.5, 11.5, ..."""
    return np.where(level > 1, 1.5 * 2.0 ** np.maximum(level - 1, 0) - 0.5, level)


@dataclass(frozen=True)
class Filter:
    """Segments of buckets in a row: bytes, and where each begins."""

    data: np.ndarray
    begins: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; 0 if it isn't in."""
        buckets = len(self.begins) - 1
        bucket = bucket_of(keys, buckets)
        begin, bits = self.begins[bucket], (np.diff(self.begins) * 8).astype(np.uint64)[bucket]
        level = np.zeros(len(keys), np.int64)
        active = np.flatnonzero(bits)
        for n in range(1, MAX_LEVELS):
            if not len(active):
                break
            for probe in range(PROBES):
                if not len(active):
                    break
                at = _positions(keys[active], n, probe, bits[active])
                byte = self.data[begin[active] + (at >> np.uint64(3)).astype(np.int64)]
                active = active[(byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            level[active] = n
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The estimated count of each key; 0 if it isn't in."""
        return estimated(self.levels(keys))


def count_grams(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed counts of words and pairs by bucket: (bucket, words, word_counts, pairs, pair_counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            tokens = np.concatenate(held)
            parts: dict[int, list] = {}
            for i, keys in enumerate((tokens, pairs_of(tokens))):
                keys, counts = np.unique(keys, return_counts=True)
                for bucket, where in by_bucket(keys, buckets):
                    parts.setdefault(bucket, [b"", b"", b"", b""])[2 * i : 2 * i + 2] = [
                        pack(keys[where]), counts[where].astype("<u4").tobytes()
                    ]
            columns = [pa.array(list(parts), pa.int32())]
            columns += [pa.array(c, pa.binary()) for c in zip(*parts.values())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "words", "word_counts", "pairs", "pair_counts"])

        for batch in pieces(batches, READ_BYTES):
            # A text's tokens stay together, so a first word always follows END.
            tokens, _ = tokens_of(batch.column("text"))
            held.append(tokens)
            size += len(tokens)
            if size >= FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if size:
            yield flush()

    return rows.select("text").mapInArrow(run, "bucket int, words binary, word_counts binary, pairs binary, pair_counts binary")


def merge_grams(packed: DataFrame, buckets: int, bits_per_entry: int) -> DataFrame:
    """One row a bucket: its words with their counts, their numbers, and its segment of the filter."""

    def merged(held: list[dict]) -> tuple:
        both = []
        for name in ("word", "pair"):
            keys = np.concatenate([unpack(row[f"{name}s"]) for row in held])
            counts = np.concatenate([np.frombuffer(row[f"{name}_counts"], "<u4").astype(np.int64) for row in held])
            both.append(summed(keys, counts))
        (words, counts), _ = both
        grams, times = (np.concatenate(x) for x in zip(*both))
        segment = segment_of(grams, times, bits_per_entry)
        return held[0]["bucket"], pack(words), counts.astype("<i8").tobytes(), len(words), int(counts.sum()), segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in zip(merged(rows), (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
                ["bucket", "words", "counts", "n_words", "n_tokens", "segment"],
            )

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield told(held)
                    held = []
                held.append(row)
        if held:
            yield told(held)

    return (
        packed.repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(run, "bucket int, words binary, counts binary, n_words bigint, n_tokens bigint, segment binary")
    )


def _squeezed(data: np.ndarray) -> bytes:
    """Entropy-coded bytes: Spark's own codecs for shuffles only find repeats."""
    coder = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, 9, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(np.ascontiguousarray(data)) + coder.flush()


def _text_blocks(rows: DataFrame) -> DataFrame:
    """A row for about ``BLOCK_BYTES`` of text: block (the number of its first row), ids, learned, sizes
    (tokens of each text), its distinct words, packed, their order by frequency, and each token's place
    in that order, in byte planes."""
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            *T.StructType.fromDDL("learned array<boolean>, sizes array<bigint>, words binary, often binary, word_of binary"),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        held, size = [], 0

        def told() -> pa.RecordBatch:
            ids, learned, tokens, sizes = zip(*held)
            ids, learned, sizes = pa.concat_arrays(ids), pa.concat_arrays(learned), np.concatenate(sizes)
            words, of, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            span = pa.array([0, len(ids)], pa.int32())
            # Frequent words get small numbers, which the entropy coder makes short.
            often = np.argsort(-times, kind="stable")
            place = np.empty(len(words), "<u4")
            place[often] = np.arange(len(words))
            planes = np.ascontiguousarray(place[of].view(np.uint8).reshape(-1, 4).T)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block]),
                    pa.ListArray.from_arrays(span, ids),
                    pa.ListArray.from_arrays(span, learned),
                    pa.ListArray.from_arrays(span, pa.array(sizes, pa.int64())),
                    pa.array([pack(words)], pa.binary()),
                    pa.array([pack(often)], pa.binary()),
                    pa.array([_squeezed(planes)], pa.binary()),
                ],
                schema.names,
            )

        for batch in pieces(batches, READ_BYTES):
            tokens, sizes = tokens_of(batch.column("text"))
            held.append((batch.column("doc_id"), batch.column("learned"), tokens, sizes))
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield told()
                pa.default_memory_pool().release_unused()
                block, held, size = block + sum(len(ids) for ids, *_ in held), [], 0
        if held:
            yield told()

    return rows.mapInArrow(run, schema)


def _block_tokens(words: bytes, often: bytes, word_of: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct words, the number of each token's word, and its tokens."""
    distinct = unpack(words)
    place = np.ascontiguousarray(np.frombuffer(zlib.decompress(word_of), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    of = unpack(often).astype(np.int64)[place]
    return distinct, of, distinct[of]


def _probes(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, words, pairs): the distinct n-grams of each block, packed, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                distinct, _, tokens = _block_tokens(*(batch.column(n)[i].as_py() for n in ("words", "often", "word_of")))
                parts: dict[int, list] = {}
                for n, keys in enumerate((distinct, np.unique(pairs_of(tokens)))):
                    for bucket, where in by_bucket(keys, buckets):
                        parts.setdefault(bucket, [b"", b""])[n] = pack(keys[where])
                columns = [pa.array([batch.column("block")[i].as_py()] * len(parts), pa.int64()), pa.array(list(parts), pa.int32())]
                columns += [pa.array(c, pa.binary()) for c in zip(*parts.values())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "words", "pairs"])

    return blocks.select("block", "words", "often", "word_of").mapInArrow(run, "block bigint, bucket int, words binary, pairs binary")


def _answers(model: DataFrame, blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, word_levels, pair_levels): the level of each n-gram that was probed, squeezed bytes."""
    none = F.lit(None)
    segments = model.select(none.cast("bigint").alias("block"), "bucket", none.cast("binary").alias("words"), none.cast("binary").alias("pairs"), "segment")
    asked = _probes(blocks, buckets).withColumn("segment", none.cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, segment = None, b""

        def told(asked: list[dict]) -> pa.RecordBatch:
            mine = segment if asked[0]["bucket"] == of else b""
            keys = [unpack(row[n]) for row in asked for n in ("words", "pairs")]
            grams = Filter(np.frombuffer(mine, np.uint8), np.array([0, len(mine)]))
            found = grams.levels(np.concatenate(keys)).astype(np.uint8)
            found = [_squeezed(x) for x in np.split(found, np.cumsum([len(k) for k in keys])[:-1])]
            columns = [[row["block"] for row in asked], [row["bucket"] for row in asked], found[::2], found[1::2]]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "bucket", "word_levels", "pair_levels"])

        for batch in batches:
            asked, size = [], 0
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if asked and (asked[0]["bucket"] != row["bucket"] or size >= BLOCK_BYTES):
                    yield told(asked)
                    asked, size = [], 0
                if row["block"] is None:  # comes before its bucket's probes
                    of, segment = row["bucket"], row["segment"]
                    continue
                asked.append(row)
                size += len(row["words"]) + len(row["pairs"])
            if asked:
                yield told(asked)
            pa.default_memory_pool().release_unused()

    return (
        segments.unionByName(asked)
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
        .mapInArrow(run, "block bigint, bucket int, word_levels binary, pair_levels binary")
    )


def _frequent_words(model: DataFrame, least: int) -> DataFrame:
    """(words, counts) packed, of the words with at least ``least`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unpack(row["words"]), np.frombuffer(row["counts"], "<i8")
                chosen = counts >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pack(words[chosen])], pa.binary()), pa.array([counts[chosen].tobytes()], pa.binary())], ["words", "counts"]
                )

    return model.select("words", "counts").mapInArrow(run, "words binary, counts binary")


def _rare_words(model: DataFrame, below: int) -> DataFrame:
    """(word, c) of the words that are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unpack(row["words"]).view(np.int64), np.frombuffer(row["counts"], "<i8")
                chosen = counts < below
                yield pa.RecordBatch.from_arrays([pa.array(words[chosen]), pa.array(counts[chosen])], ["word", "c"])

    return model.select("words", "counts").mapInArrow(run, "word bigint, c bigint")


def _head_level(model: DataFrame, head_words: int) -> int:
    """The least count (a power of two) with at most ``head_words`` words that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                level, words = np.unique(levels(np.frombuffer(counts, "<i8")), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(words, pa.int64())], ["level", "words"])

    by_level = dict(model.select("counts").mapInArrow(run, "level int, words bigint").groupBy("level").agg(F.sum("words")).collect())
    level, words = max(by_level, default=1) + 1, 0
    while level > 1 and words + by_level.get(level - 1, 0) <= head_words:
        level -= 1
        words += by_level.get(level, 0)
    return 1 << (level - 1)


def score_texts(
    df: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_entry: int = BITS_PER_ENTRY,
    head_words: int = HEAD_WORDS,
    pair_weight: float = PAIR_WEIGHT,
) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score; a row for each row of ``df``.

    Scores are log10 probabilities of the whole text and its end. base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) with exact counts of the rows where ``learn`` holds;
    n_known counts tokens with c > 0; score is the model's. NULL texts are empty and have their end
    alone; identifiers are carried along, NULL and repeats included; other columns are ignored.
    Without rows to learn from all counts are zero.
    """
    spark = df.sparkSession
    buckets = FINER * shuffle_parts(spark)
    rows = df.select(
        col(id_col).alias("doc_id"),
        F.coalesce(learn, F.lit(False)).alias("learned"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    model = stage(merge_grams(count_grams(rows.filter("learned"), buckets), buckets, bits_per_entry), "grams")
    total = model.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    n, v = total
    whole = n + SMOOTHING * (v + 1)

    least = _head_level(model, head_words)
    head = _frequent_words(model, least).collect()
    words = np.concatenate([np.empty(0, np.uint64), *(unpack(bytes(row["words"])) for row in head)])
    counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(bytes(row["counts"]), "<i8") for row in head)])
    order = np.argsort(words)
    shared_head = spark.sparkContext.broadcast((words[order], counts[order]))

    def scores(block: dict, word_level: np.ndarray, pair_level: np.ndarray) -> pa.RecordBatch:
        head_words, head_counts = shared_head.value
        distinct, inverse, tokens = _block_tokens(block["words"], block["often"], block["word_of"])
        per_text = block["sizes"]
        begins = np.cumsum(per_text) - per_text
        # The exact part: the head's words here, the others by a join.
        at = np.minimum(np.searchsorted(head_words, distinct), max(0, len(head_words) - 1))
        in_head = head_words[at] == distinct if len(head_words) else np.zeros(len(distinct), bool)
        c = np.where(in_head, head_counts[at] if len(head_words) else 0, 0)
        base = np.where(in_head, np.log10((c + SMOOTHING) / whole), 0.0)
        rare = np.flatnonzero(~in_head[inverse])
        text = np.searchsorted(begins, rare, "right") - 1
        # The model's part: counts of word, history and pair from the filter.
        word_count = estimated(word_level)
        alone = (word_count + SMOOTHING) / whole
        pair_count = estimated(pair_level)[np.unique(pairs_of(tokens), return_inverse=True)[1]]
        end_count = word_count[np.searchsorted(distinct, END)]
        history = np.concatenate([[end_count], word_count[inverse][:-1]])
        share = np.minimum(1.0, pair_count / np.maximum(history, 1))
        known = history > 0
        p = np.where(known, pair_weight * share + (1 - pair_weight) * alone[inverse], alone[inverse])
        rare_begins = np.searchsorted(text, np.arange(len(per_text) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(block["block"] + np.arange(len(per_text))),
                block["ids"],
                block["learned"],
                pa.array(per_text, pa.int64()),
                pa.array(np.add.reduceat(in_head[inverse].astype(np.int64), begins)),
                pa.array(np.add.reduceat(base[inverse], begins)),
                pa.array(np.add.reduceat(np.log10(p), begins)),
                pa.ListArray.from_arrays(pa.array(rare_begins), pa.array(tokens[rare].view(np.int64))),
            ],
            ["row", "doc_id", "learned", "n_tokens", "head_known", "head_base", "score", "rare"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, word_levels, pair_levels = None, [], []

        def told() -> pa.RecordBatch:
            return scores(block, *(np.frombuffer(b"".join(x), np.uint8).astype(np.int64) for x in (word_levels, pair_levels)))

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                if not row["bucket"].is_valid:  # the block itself comes before its answers, which come by bucket
                    if block is not None:
                        yield told()
                    block, word_levels, pair_levels = {n: row[n].as_py() for n in ("block", "words", "often", "word_of")}, [], []
                    block |= {n: row[n].values for n in ("ids", "learned")} | {"sizes": np.asarray(row["sizes"].values)}
                else:
                    word_levels.append(zlib.decompress(row["word_levels"].as_py()))
                    pair_levels.append(zlib.decompress(row["pair_levels"].as_py()))
        if block is not None:
            yield told()

    head_schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            *rows.drop("text").schema,
            *T.StructType.fromDDL("n_tokens bigint, head_known bigint, head_base double, score double, rare array<bigint>"),
        ]
    )
    blocks = stage(_text_blocks(rows), "blocks")
    both = blocks.unionByName(_answers(model, blocks, buckets), allowMissingColumns=True)
    both = both.repartition(buckets, "block").sortWithinPartitions("block", F.col("bucket").asc_nulls_first())
    scored = stage(both.mapInArrow(run, head_schema), "scored")
    c = F.coalesce("c", F.lit(0))
    rest = (
        scored.select("row", F.explode("rare").alias("word"))
        .join(_rare_words(model, least), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10((c + F.lit(SMOOTHING)) / F.lit(float(whole)))).alias("rest_base"),
            F.sum((c > 0).cast("bigint")).alias("rest_known"),
        )
    )
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id",
        "learned",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
