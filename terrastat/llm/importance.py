"""Importance resampling towards a target, over hashed words with a head-tail vocabulary.

A text's features are its runs of one word, or of one and two words, and a feature's bucket is the
crc32 of its bytes modulo the number of buckets. The most frequent words (the head) are broadcast
with the state of their crc32, the most frequent pairs with their bucket: a pair whose first word is
in the head only goes on from that state. All other features, the tail, take their crc32 directly.
Both give the same buckets, so the bucket totals are exact whatever the head holds.

A bucket's gain is the logarithm of its share among the target's features over its share among all;
a document's weight is the mean gain of its features, and Gumbel noise drawn from its identifier
turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col, pieces, shuffle_parts, stage, texts_of

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words, and as many pairs, that are broadcast; none of more bytes than HEAD_BYTES is.
HEAD = 1 << 15
HEAD_BYTES = 64
#: Bytes of text whose words are in hand at once; a longer word is taken whole.
RUN_BYTES = 1 << 18

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for each stretch of about RUN_BYTES.

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII.
    """
    text = text.lower()  # of bytes: A-Z alone
    first = 0
    while first < len(text):
        gap = _GAP.search(text, first + RUN_BYTES)
        last = gap.end() if gap else len(text)
        if words := _WORD.findall(text, first, last):
            yield words
        first = last


class _Head(dict):
    """crc32 states of the head; a word of the tail is hashed each time."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class Vocabulary:
    """The head: crc32 states of frequent words and buckets of frequent pairs."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int):
        self.states = _Head((w, crc32(w)) for w in words)
        self.pairs = {p: crc32(p) % buckets for p in pairs}
        self.buckets = buckets

    def text_buckets(self, text: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """Number of words, and the buckets of all features, of one stretch of the text after the other."""
        state, pairs, buckets = self.states.__getitem__, self.pairs, self.buckets
        before: list[bytes] = []
        for words in word_runs(text):
            states = list(map(state, words))
            found = [np.array(states, np.int64) % buckets]
            if longest == 2:
                linked = before + words
                first_states = [state(w) for w in before] + states
                of_pairs = []
                for i in range(len(linked) - 1):
                    bucket = pairs.get(linked[i] + b" " + linked[i + 1])
                    of_pairs.append(crc32(b" " + linked[i + 1], first_states[i]) % buckets if bucket is None else bucket)
                found.append(np.array(of_pairs, np.int64))
                before = words[-1:]
            yield len(words), np.concatenate(found)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def frequent(texts: DataFrame, longest: int, head: int = HEAD) -> tuple[list[bytes], list[bytes]]:
    """About the ``head`` most frequent words and pairs of all texts.

    Each task counts all its features in a table that is cut back to the most frequent ``2 * head``
    whenever it holds four times as many, and sends ``head`` rows at most; of words too long for the
    head it keeps the beginning, which is not sent. A word that is missed here is hashed directly
    later, so the result does not depend on it. The driver gets ``2 * head`` names
    of at most HEAD_BYTES.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(longest)]
        for batch in pieces(batches):
            for text in _bytes(batch):
                before: list[bytes] = []
                for words in word_runs(text):
                    if len(max(words, key=len)) > HEAD_BYTES:
                        words = [w if len(w) <= HEAD_BYTES else w[: HEAD_BYTES + 1] for w in words]
                    linked = before + words
                    counts[0].update(words)
                    if longest == 2:
                        counts[1].update(a + b" " + b for a, b in zip(linked, linked[1:]))
                        before = words[-1:]
                    for i, count in enumerate(counts):
                        if len(count) > 8 * head:
                            counts[i] = Counter(dict(count.most_common(2 * head)))
        for i, count in enumerate(counts):
            most = [(w, n) for w, n in count.most_common(head) if len(w) <= HEAD_BYTES]
            yield pa.RecordBatch.from_pydict(
                {
                    "length": pa.array([i + 1] * len(most), pa.int32()),
                    "feature": pa.array([w for w, _ in most], pa.binary()),
                    "n": pa.array([n for _, n in most], pa.int64()),
                }
            )

    counted = texts.select("text").mapInArrow(run, "length int, feature binary, n bigint").groupBy("length", "feature").agg(F.sum("n").alias("n"))
    found = [
        [bytes(r.feature) for r in counted.where(F.col("length") == i).orderBy(F.desc("n"), "feature").limit(head).collect()]
        for i in range(1, longest + 1)
    ]
    return found[0], found[1] if longest == 2 else []


def bucket_totals(texts: DataFrame, vocabulary: Vocabulary, longest: int) -> np.ndarray:
    """How many features of all texts each bucket holds; a task sends one row for each bucket at most."""
    broadcast = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = broadcast.value
        total = np.zeros(known.buckets, np.int64)
        for batch in pieces(batches):
            for text in _bytes(batch):
                for _, buckets in known.text_buckets(text, longest):
                    total += np.bincount(buckets, minlength=known.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(vocabulary.buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket, in doubles."""
    buckets = len(source)
    all_source, all_target = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log(float(t + 1) * all_source / (float(s + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def weights(texts: DataFrame, vocabulary: Vocabulary, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of all features, 0 without any."""
    broadcast = texts.sparkSession.sparkContext.broadcast((vocabulary, gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = broadcast.value
        for batch in pieces(batches):
            rows = []
            for text in _bytes(batch):
                n_words = n = total = 0
                for count, buckets in known.text_buckets(text, longest):
                    n_words, n, total = n_words + count, n + len(buckets), total + int(gain[buckets].sum())
                rows.append((n_words, n, total // n if n else 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2^32))), h being the first 8 hex digits of sha256 of ``seed:id``."""
    name = F.coalesce(id_col.cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in ``order``: dealt by range, written, and numbered part by part."""
    spark = rows.sparkSession
    parts = shuffle_parts(spark)
    dealt = stage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "importance-ranks")
    counts = dict(dealt.groupBy("_part").count().collect())
    start, starts = 0, []
    for part in sorted(counts):  # one number for each part of the shuffle
        starts.append((part, start))
        start += counts[part]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    offsets = F.broadcast(spark.createDataFrame(starts, "_part int, _start bigint"))
    return dealt.withColumn("_place", inside).join(offsets, "_part").withColumn("rank", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    *,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    head: int = HEAD,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each document; undrawn ones have no rank.

    Drawn are the ``percent`` % (rounded down) highest scores among documents of at least
    ``least_words`` words, ties to the smaller identifier, a NULL one last. A NULL text is empty: it
    has no features, weight 0, and is never drawn unless ``least_words`` is 0. Repeated rows count
    each on its own; equal rows share the noise and take successive ranks. An empty target gives all
    buckets its share of nothing, an empty table no row. Other columns are ignored.

    Texts are read three times (head, totals, weights) and never shuffled; four numbers a document
    are written, and those whose score reaches the last drawn one are dealt by range to be ranked.
    """
    if longest not in (1, 2):
        raise ValueError("features are runs of one word, or of one and two")
    texts = texts_of(docs, id_col, text_col)
    wanted = target.select(F.coalesce(col(target_text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = Vocabulary(*frequent(texts, longest, head), buckets)
    gain = gains(bucket_totals(texts, vocabulary, longest), bucket_totals(wanted, vocabulary, longest))
    weighed = weights(texts, vocabulary, gain, longest)
    scored = stage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance")

    eligible = F.col("n_words") >= least_words
    # Scores are whole thousandths of logarithms of ratios of longs: some 200,000 values at most.
    histogram = sorted(scored.where(eligible).groupBy("score").count().collect(), reverse=True)
    wanted_rows = percent * sum(n for _, n in histogram) // 100
    cut, above = None, 0
    for score, n in histogram:
        if above >= wanted_rows:
            break
        cut, above = score, above + n
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if cut is None:
        return scored.select(*columns, none)
    reached = eligible & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    ranked = _ranked(scored.where(reached).select(*columns), order)
    drawn = ranked.select(*columns, F.when(F.col("rank") <= wanted_rows, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~reached).select(*columns, none))
