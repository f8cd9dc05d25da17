"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into blocks. Two that differ in at most ``max_bits`` bits agree in all but
``max_bits`` blocks at least, so they meet under the key of some choice of whole blocks; under each
key the candidates are verified by their Hamming distance. Equal fingerprints are one node, so
copies never meet as pairs, and a key's candidates give the links that connect them, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import col, flat, join_split, lower, pieces, row_key, rows_with_keys, schema_of, shuffle_parts, stage, word_spans
from .components import components

WORDS = 4
MAX_BITS = 4
SEED = 42
#: Bytes of text that are hashed at once.
HASHED_BYTES = 1 << 20
#: More blocks: longer keys and so fewer candidates, but more keys for each fingerprint.
BLOCKS = 7
#: Fingerprints under one key that one task compares; a larger key is dealt out as pairs of parts.
KEY_ROWS = 1 << 14


def fingerprints_of(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is 1 if set in over half of the shingles' XXH64.

    Shingles are ``words`` consecutive words (A-Z lower-cased) joined by one space, repeats
    included; a text with fewer words is one shingle, one without words has fingerprint zero.
    """
    data, offsets = flat(texts)
    data = lower(data)
    starts, ends, first = word_spans(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    # The words alone, with one space between: a shingle is then one slice.
    lengths = ends - starts + 1
    begins = np.cumsum(lengths) - lengths
    line = np.full(int(lengths.sum()), 32, np.uint8)
    inside = np.ones(len(line), bool)
    inside[begins + lengths - 1] = False
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    line[inside] = data[np.cumsum(keep[:-1]).astype(bool)]
    line = line.tobytes()
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    of = np.repeat(np.arange(len(count)), shingles)
    begin_word = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles))
    end_word = np.minimum(begin_word + words, first[of + 1]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(begins[begin_word].tolist(), (begins[end_word] + lengths[end_word] - 1).tolist())),
        np.uint64,
        len(of),
    )
    upto = np.concatenate([[0], np.cumsum(shingles)])
    filled = np.flatnonzero(shingles)
    cut = upto[filled]
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), cut)
        out[filled] |= (2 * ones > shingles[filled]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, row_key, fingerprint bigint), a row for each row of ``df``; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, HASHED_BYTES):
            marks = fingerprints_of(batch.column("text"), words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(marks)],
                ["doc_id", "row_key", "fingerprint"],
            )

    rows = df.select(
        col(id_col).alias("doc_id"),
        row_key(id_col, text_col).alias("row_key"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, schema_of(rows.drop("text"), "fingerprint bigint"))


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """The bits of every choice of blocks that close fingerprints can agree in."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("0 <= max_bits < blocks <= 64 is needed")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(bits, blocks - max_bits)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def connect(marks: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect all of ``marks`` that are reachable by steps of at most ``max_bits``.

    Each mark is compared with those not yet connected to it, so the work falls as groups grow.
    """
    group = np.arange(len(marks))
    links = []
    for i in range(len(marks)):
        others = np.flatnonzero(group != group[i])
        if not len(others):
            break
        near = others[np.bitwise_count(marks[others] ^ marks[i]) <= max_bits]
        for j in near:
            if group[j] != group[i]:
                links.append((i, int(j)))
                group[group == group[j]] = group[i]
    return links


def _linked(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within each key; rows come sorted by key. Only an unfinished key is carried over."""
    rest_key, rest_mark = np.empty((0, 4), np.int64), np.empty(0, np.uint64)

    def links(keys: np.ndarray, marks: np.ndarray):
        new = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        begins, ends = np.concatenate([[0], new]), np.concatenate([new, [len(keys)]])
        size = ends - begins
        pair = begins[size == 2]
        a, b = marks[pair], marks[pair + 1]
        close = np.bitwise_count(a ^ b) <= max_bits
        found_a, found_b = [a[close]], [b[close]]
        for begin, end in zip(begins[size > 2], ends[size > 2]):
            if pairs := connect(marks[begin:end], max_bits):
                i, j = np.array(pairs).T
                found_a.append(marks[begin:end][i])
                found_b.append(marks[begin:end][j])
        a, b = (np.concatenate(x).view(np.int64) for x in (found_a, found_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("choice", "part", "cell_a", "cell_b")], axis=1)
        keys = np.concatenate([rest_key, keys])
        marks = np.concatenate([rest_mark, np.asarray(batch.column("fingerprint")).view(np.uint64)])
        last = np.flatnonzero(np.any(keys != keys[-1], axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest_key, rest_mark = keys[cut:], marks[cut:]
        if cut:
            yield links(keys[:cut], marks[:cut])
    if len(rest_key):
        yield links(rest_key, rest_mark)


def close_links(
    marks: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, key_rows: int = KEY_ROWS
) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column ``fingerprint``) within ``max_bits``.

    A key under which more than ``key_rows`` fingerprints meet is dealt out in parts, and every
    pair of parts is a task's work of its own: nothing is left out and no task holds more than two.
    """
    keyed = marks.select(
        "fingerprint",
        F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in block_masks(blocks, max_bits)])).alias("choice", "part"),
    )
    crowded = (
        keyed.groupBy("choice", "part")
        .agg(F.count("*").alias("rows"))
        .filter(F.col("rows") > key_rows)
        .select("choice", "part", F.ceil(F.col("rows") / key_rows).cast("int").alias("parts"))
    )
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.struct(F.least(i, own).alias("a"), F.greatest(i, own).alias("b")),
    )
    dealt = (
        keyed.join(crowded, ["choice", "part"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("cell", F.explode(cells))
        .select(
            F.col("choice").cast("bigint"),
            "part",
            F.col("cell.a").cast("bigint").alias("cell_a"),
            F.col("cell.b").cast("bigint").alias("cell_b"),
            "fingerprint",
        )
    )
    key = ["choice", "part", "cell_a", "cell_b"]
    return (
        dealt.repartition(shuffle_parts(marks.sparkSession), *key)
        .sortWithinPartitions(*key, "fingerprint")
        .mapInArrow(lambda batches: _linked(batches, max_bits), "a bigint, b bigint")
    )


def _resolved(df: DataFrame, id_col: str, text_col: str, words: int, max_bits: int, blocks: int) -> DataFrame:
    """(doc_id, row_key, fingerprint, root): root is the same for all that are reachable."""
    docs = stage(fingerprints(df, id_col, text_col, words), "simhash")
    links = close_links(docs.select("fingerprint").distinct(), max_bits, blocks)
    roots = components(links).toDF("fingerprint", "root")
    return docs.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def simhash_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id; a row for each row of ``df``.

    component_id is the smallest identifier among all rows reachable by steps between fingerprints
    that differ in at most ``max_bits`` bits, the row itself included. NULL text counts as empty;
    texts without words have fingerprint zero and link like any other. NULL identifiers are never
    the smallest (component_id is NULL where all are); rows may repeat. Other columns are ignored.
    """
    found = _resolved(df, id_col, text_col, words, max_bits, blocks)
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return join_split(found, least, ["root"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row of ``df`` for each group of :func:`simhash_groups`: that of the smallest identifier.

    Among rows that share it, the smallest text hash decides; a NULL identifier comes last.
    """
    found = _resolved(df, id_col, text_col, words, max_bits, blocks)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key")
    keys = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row_key").alias("row_key"))
    return rows_with_keys(df, id_col, text_col, keys)
