"""Token ids in Arrow stream files of equal-length sequences.

A file is one Arrow stream; its batches hold two fixed-size lists a row: the ids of a sequence and
its mask. All sequences have the same length and all batches but the last the same number of them,
so sequence i of a mapped file is a view of known place, not a copy. Documents follow each other
without gaps, in ascending order of their identifiers; only the last sequence of a file is filled
up, with mask false. Ids take two bytes where the vocabulary allows it.

Files are written by range of identifiers, a file for each part. The index (file, document, first
token in the file, number of tokens) is the rows that the writing tasks return.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from re import compile as pattern

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from terrastat.sources import stage as write_and_reread

from . import files
from .chunks import TABLE_ROWS, ChunkTable
from .common import pieces, shuffle_parts, texts_of

LENGTH = 2048
#: Sequences in one batch of a file.
BATCH_ROWS = 128
#: Fixed value: how byte-level vocabularies write a space.
SPACE = "Ġ"

# A text may be cut before a space that follows anything but white space: no token of the byte-level
# pattern runs over such a place, and none looks across it.
_CUT = pattern(r"(?<=\S)(?= )")
_UNCERTAIN = "^ |[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "


#: Bytes of text whose chunks are looked up at once: the more, the fewer look-ups of a chunk.
ENCODED_BYTES = 4 << 20


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def separable(path: str) -> bool:
    """Whether this is a byte-level vocabulary, without normaliser, that splits words at spaces."""
    t = tokenizer(path)
    if t.normalizer is not None or t.padding is not None or t.truncation is not None:
        return False
    kind = str(t.pre_tokenizer)
    return kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind and not any(
        " " in token.content or token.lstrip or token.rstrip or token.single_word for token in t.get_added_tokens_decoder().values()
    )


@lru_cache(maxsize=1)
def _table(path: str, table_rows: int) -> ChunkTable:
    """The table of this Python worker, which goes on from task to task."""
    t = tokenizer(path)
    # A word of ASCII letters is one token of the pre-tokenizer: the model alone gives its ids.
    alone = not any(x.content.isalpha() for x in t.get_added_tokens_decoder().values())

    def segment(names: list) -> list[list[int]]:
        out, rest = [None] * len(names), []
        for i, name in enumerate(names):
            if alone and isinstance(name, str) and name.isascii() and name.isalpha():
                out[i] = [token.id for token in t.model.tokenize(SPACE + name)]
            else:
                rest.append(i)
        texts = [names[i][0] if isinstance(names[i], tuple) else " " + names[i] for i in rest]
        for i, found in zip(rest, t.encode_batch_fast(texts, add_special_tokens=False)):
            out[i] = found.ids
        return out

    return ChunkTable(segment, table_rows)


def token_ids(batches: Iterator[pa.RecordBatch], path: str, table_rows: int = TABLE_ROWS) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Identifiers, the ids of all texts in a row and how many each has, batch by batch.

    Exactly the library's ids for each whole text, without special tokens around it. Chunks that
    begin at a certain cut are segmented once a table and joined back by position.
    """
    t = tokenizer(path)
    table = _table(path, table_rows) if separable(path) else None
    for batch in pieces(batches, ENCODED_BYTES):
        texts = batch.column("text")
        if table is None:
            each = [found.ids for found in t.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            yield batch.column("doc_id"), np.array([i for ids in each for i in ids], np.int32), lengths
            continue
        table.begin()
        if pc.any(pc.match_substring_regex(texts, _UNCERTAIN)).as_py():
            lists = [_CUT.split(text) for text in texts.to_pylist()]
            per_text = np.fromiter(map(len, lists), np.int64, len(lists))
            # Every chunk but a text's first begins with the space that its name goes without.
            names = [chunk[1:] if i else chunk for chunks in lists for i, chunk in enumerate(chunks)]
            chunks = pa.array(names, pa.string())
        else:
            split = pc.split_pattern(texts, " ")
            per_text, chunks = np.asarray(pc.list_value_length(split), dtype=np.int64), split.flatten()
        first = np.cumsum(per_text) - per_text
        heads = chunks.take(pa.array(first)).to_pylist()
        coded = chunks.dictionary_encode()
        rows = table.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)]
        distinct = list(dict.fromkeys(heads))
        found = dict(zip(distinct, table.find([(head,) for head in distinct]).tolist()))
        rows[first] = [found[head] for head in heads]
        yield batch.column("doc_id"), *table.join(rows, per_text)


class SequenceWriter:
    """Packs ids into sequences of one stream file."""

    def __init__(self, location: str, part: int, kind: pa.DataType, length: int):
        self.name, self.kind, self.length = files.new_name(part, "arrows"), kind, length
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = files.create(location, self.name)
        self.stream = pa.ipc.new_stream(self.file, self.schema)
        self.waiting, self.count, self.written = [], 0, 0

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        self.stream.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)],
                schema=self.schema,
            )
        )

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.count += len(ids)
        self.written += len(ids)
        full = self.length * BATCH_ROWS
        if self.count >= full:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // full * full
            for at in range(0, whole, full):
                self._batch(ids[at : at + full], full)
            self.waiting, self.count = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.count:
            ids = np.concatenate(self.waiting)
            filled = np.zeros(-(-len(ids) // self.length) * self.length, ids.dtype)
            filled[: len(ids)] = ids
            self._batch(filled, len(ids))
        self.stream.close()
        self.file.close()


def write_tokens(
    df: DataFrame,
    location: str,
    tokenizer_path: str,
    end_id: int | None = 0,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of all texts to ``location``; returns the index, stored there as well.

    The index has a row for each row of ``df``: part, file, doc_id, begin (first token in the file),
    n_tokens (with ``end_id``, if given, after each document). Documents are ordered by identifier,
    NULL first; rows that share one follow each other in the order of a text hash. NULL texts are
    empty; other columns are ignored. The texts are shuffled once, by range, and encoded after it.
    """
    n = shuffle_parts(df.sparkSession)
    rows = texts_of(df, id_col, text_col).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").drop("tie", "row")
    data = f"{location}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        t = tokenizer(tokenizer_path)
        kind = pa.uint16() if max(t.get_vocab_size(), end_id or 0) <= 1 << 16 else pa.uint32()
        tail = np.array([] if end_id is None else [end_id], kind.to_pandas_dtype())
        for doc_ids, ids, lengths in token_ids(batches, tokenizer_path):
            writer = writer or SequenceWriter(data, part, kind, length)
            begin, ids = writer.written, ids.astype(kind.to_pandas_dtype())
            ends = np.cumsum(lengths)
            writer.add(np.insert(ids, np.repeat(ends, len(tail)), np.tile(tail, len(ends))))
            counts = lengths + len(tail)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), part), pa.int32()),
                    pa.array([writer.name] * len(counts)),
                    doc_ids,
                    pa.array(begin + np.cumsum(counts) - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                ],
                ["part", "file", "doc_id", "begin", "n_tokens"],
            )
        if writer:
            writer.close()

    schema = T.StructType(
        [
            *T.StructType.fromDDL("part int, file string"),
            *rows.select("doc_id").schema,
            *T.StructType.fromDDL("begin bigint, n_tokens bigint"),
        ]
    )
    return write_and_reread(rows.mapInArrow(run, schema), f"{location}/index")


class TokenFile:
    """A mapped stream file; batches and sequences are views of it."""

    def __init__(self, location: str):
        table = pa.ipc.open_stream(files.open_mapped(location)).read_all()
        self.ids = [chunk.values.to_numpy(zero_copy_only=True) for chunk in table["ids"].chunks]
        self.masks = table["mask"]
        self.upto = np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype(np.int64)
        self.length = table.schema.field("ids").type.list_size

    def tokens(self, begin: int, n: int) -> np.ndarray:
        """Tokens from ``begin`` on: a view, or a copy where they lie in several batches."""
        parts, end = [], begin + n
        at = int(np.searchsorted(self.upto, begin, "right")) - 1
        while begin < end:
            stop = min(end, int(self.upto[at + 1]))
            parts.append(self.ids[at][begin - self.upto[at] : stop - self.upto[at]])
            begin, at = stop, at + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def sequence(self, i: int) -> np.ndarray:
        return self.tokens(i * self.length, self.length)


def read_tokens(index: DataFrame, location: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files through the index.

    start counts the ids of all documents before; ids_crc32 is the unsigned crc32 of the ids as
    little-endian unsigned 32-bit integers. The running total is over one row for each file.
    """
    data = f"{location}/data"
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        index.groupBy("part")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("earlier"))
    )
    rows = index.join(offsets, "part").select("file", "doc_id", (F.col("earlier") + F.col("begin")).alias("start"), "begin", "n_tokens")
    schema = rows.select("doc_id", "start", "n_tokens", F.lit(0).cast("bigint").alias("ids_crc32")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            sums = []
            for wanted, begin, n in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "n_tokens"))):
                if wanted != name:
                    name, file = wanted, TokenFile(f"{data}/{wanted}")
                sums.append(zlib.crc32(file.tokens(begin, n).astype("<u4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], schema.names
            )

    return rows.mapInArrow(run, schema)


def read_sequences(index: DataFrame, location: str) -> DataFrame:
    """(file, sequence, ids, mask): every equal-length sequence of the files that the index names."""
    data = f"{location}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                done = 0
                for found in pa.ipc.open_stream(files.open_mapped(f"{data}/{name}")):
                    ids, mask = found.column("ids"), found.column("mask")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(ids)),
                            pa.array(np.arange(done, done + len(ids))),
                            ids.cast(pa.list_(ids.type.value_type)).cast(pa.list_(pa.int32())),
                            mask.cast(pa.list_(pa.bool_())),
                        ],
                        ["file", "sequence", "ids", "mask"],
                    )
                    done += len(ids)

    return index.select("file").distinct().mapInArrow(run, "file string, sequence bigint, ids array<int>, mask array<boolean>")
