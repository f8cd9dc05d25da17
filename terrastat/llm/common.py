"""Shared pieces of the text operators: staged tables, Arrow batches in bounded pieces, words.

A text is a string column; NULL counts as the empty text. Words are the runs of bytes other than
space and 0x09-0x0D in the UTF-8 text, with A-Z lower-cased where an operator says so.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from terrastat.sources import stage as write_and_reread

#: Texts are worked on in pieces of about this many bytes, whatever the size of an Arrow batch.
PIECE_BYTES = 1 << 20

_own_folders: dict[str, str] = {}
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

try:
    _libc = ctypes.CDLL("libc.so.6")  # where it isn't glibc, memory is given back as the system sees fit
except OSError:
    _libc = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a session whose tasks run in this very process may go without; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if master not in _own_folders:
        _own_folders[master] = tempfile.mkdtemp(prefix="terrastat-")
        atexit.register(shutil.rmtree, _own_folders[master], ignore_errors=True)
    return _own_folders[master]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they need not find it otherwise."""
    context = spark.sparkContext
    if getattr(context, "_terrastat_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    if not top.is_dir():  # this is the shipped package itself
        return
    folder = tempfile.mkdtemp(prefix="terrastat-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/terrastat_package.zip", "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(f"{folder}/terrastat_package.zip")
    context._terrastat_shipped = True


def new_location(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives executors."""
    return write_and_reread(df, new_location(df.sparkSession, label))


def stage_and_release(df: DataFrame, label: str) -> DataFrame:
    """:func:`stage`, and Spark deletes the shuffle files of the step as soon as it is written.

    Otherwise they stay until the driver happens to collect its garbage, beside those of later steps.
    """
    conf = df.sparkSession.conf
    before = conf.get(_FILE_CLEANUP, None)
    conf.set(_FILE_CLEANUP, "true")
    try:
        return stage(df, label)
    finally:
        if before is None:
            conf.unset(_FILE_CLEANUP)
        else:
            conf.set(_FILE_CLEANUP, before)


def shuffle_parts(spark: SparkSession) -> int:
    """How many parts a shuffle of packed rows is dealt to; follows the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def col(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with underscores added until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_of(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` followed by the columns of a DDL string."""
    return T.StructType([*df.schema, *T.StructType.fromDDL(more)])


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with NULL texts empty; every other column is left behind."""
    return df.select(
        col(id_col).alias("doc_id"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def row_key(id_col: str, text_col: str) -> Column:
    """A text that tells rows apart by identifier and content, both of which may be NULL."""
    return F.concat_ws(
        "|", F.coalesce(col(id_col).cast("string"), F.lit("null")), F.sha2(F.coalesce(col(text_col), F.lit("")), 256)
    )


def join_split(rows: DataFrame, grouped: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with an aggregate of one row for each of ``keys`` (none of them NULL).

    The keys are joined as one struct. An aggregate is already dealt out by its keys, so a join on
    these would run in its stage, where Spark cannot split a hot key; the struct gets a shuffle of
    its own, which it can.
    """
    named = grouped.select(F.struct(*[F.col(k).alias(k) for k in keys]).alias("_grouped"), *[c for c in grouped.columns if c not in keys])
    return rows.join(named, F.struct(*[F.col(k).alias(k) for k in keys]) == F.col("_grouped"), how).drop("_grouped")


def rows_with_keys(df: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose :func:`row_key` is in ``keys`` (column ``row_key``), once for each key.

    One shuffle of ``df`` on the key; the removal of repeats reuses its partitioning.
    """
    key = fresh(df, "row_key")
    return (
        df.withColumn(key, row_key(id_col, text_col))
        .join(keys.select(F.col("row_key").alias(key)), key, "left_semi")
        .dropDuplicates([key])
        .select(*[col(c) for c in df.columns])
    )


def give_back() -> None:
    """Return memory that is free to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``text`` takes about ``limit`` bytes, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        upto = np.cumsum(np.asarray(sizes, dtype=np.int64))
        first = 0
        while first < batch.num_rows:
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
    give_back()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one entry more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; no other byte of UTF-8 text is in that range."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of the first word of each text (and the total)."""
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(value: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value = value ^ (value >> np.uint64(27))
    value = value * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
#: Powers that a worker keeps, and bytes of a word that the polynomial hashes: modulo 2^64, with any
#: base, it has known collisions of 1,024 bytes.
_KEPT, _LONG_WORD = 1 << 20, 256
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """The first n powers. A table of up to _KEPT, grown in doublings, stays with the worker."""
    if len(_powers.get(kind, ())) < n:
        steps = np.full(max(n, min(_KEPT, 2 * n)), base, np.uint64)
        steps[0] = 1
        powers = np.cumprod(steps, dtype=np.uint64)
        if n > _KEPT:
            return powers
        _powers[kind] = powers
    return _powers[kind][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words hash alike anywhere.

    Words of up to _LONG_WORD bytes are hashed together by one polynomial over all bytes, longer ones
    each by XXH64.
    """
    n = len(data)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=upto[1:])
    down = _power("down", pow(_BASE, -1, 1 << 64), n + 1)
    value = (upto[ends] - upto[starts]) * down[starts]
    value = mix(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        value[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return value


def ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one range after the other."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    shift = np.asarray(begins, np.int64) - (np.cumsum(lengths) - lengths)
    return out + np.repeat(shift, lengths)
