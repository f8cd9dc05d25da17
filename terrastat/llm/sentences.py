"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of a model holds a whitespace marker after another character, no piece and no merge
crosses the border before a marker. A text then is a row of independent chunks, each a marked word,
and its ids are those of its chunks one after the other. Each Python worker keeps a table of the
distinct chunks it has met: a chunk is segmented once, by the library, and its ids are joined back
to every position of that chunk by array lookups. No word occurrence is shuffled: the table is the
worker's (of a bounded size, begun anew beyond it), as joining back from one table of the whole
corpus would shuffle every occurrence.

Models whose pieces do cross markers, or whose normaliser does more than mark spaces, are handed
whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .chunks import TABLE_ROWS, ChunkTable
from .common import col, pieces, schema_of, texts_of

MARK = "▁"

@lru_cache(maxsize=4)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(maxsize=4)
def separable(model: str) -> bool:
    """Whether chunks before whitespace markers are independent under this model."""
    sp = processor(model)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        return False
    if sp.is_unknown(sp.piece_to_id(MARK)):
        return False
    # Texts that any other normalisation than marking spaces would change.
    probes = {
        "a": MARK + "a",
        " a": MARK * 2 + "a",
        "a  b ": f"{MARK}a{MARK * 2}b{MARK}",
        "\ta\n\nb\r": f"{MARK}\ta\n\nb\r",
        " 　": f"{MARK} 　",
        "ﬁＡé": f"{MARK}ﬁＡé",
        "": "",
    }
    return all(sp.normalize(text) == marked for text, marked in probes.items())


def chunks_of(text: str) -> list[str]:
    """What the library must be given to segment each marked word, in order.

    It puts a marker before its input, so a chunk goes without its first marker; "" is a marker alone.
    """
    chunks, run = [], 0
    words = text.split(" ")
    for i, word in enumerate(words):
        if word:
            chunks.append(" " * run + word)
            run = 0
        elif i or len(words) > 1:
            run += 1
    if run:
        chunks.append(" " * (run - 1))
    return chunks


@lru_cache(maxsize=1)
def _table(model: str, limit: int) -> ChunkTable:
    """The table of this Python worker, which goes on from task to task."""
    sp = processor(model)
    alone = [sp.piece_to_id(MARK)]  # a marker alone: the library has no input for it

    def segment(chunks: list[str]) -> list[list[int]]:
        found = sp.encode(chunks, num_threads=1)
        if "" in chunks:
            found[chunks.index("")] = alone
        return found

    return ChunkTable(segment, limit)


def encoded(batches: Iterator[pa.RecordBatch], model: str, bounds: bool = True, table_rows: int = TABLE_ROWS) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Identifiers and the ids of each text (int32), batch by batch."""
    sp = processor(model)
    head = np.array([sp.bos_id()] if bounds and sp.bos_id() >= 0 else [], np.int32)
    tail = np.array([sp.eos_id()] if bounds and sp.eos_id() >= 0 else [], np.int32)
    table = _table(model, table_rows) if separable(model) else None
    for batch in pieces(batches):
        texts = batch.column("text")
        if table:
            texts = pc.replace_substring(texts, MARK, " ")
            odd = pc.or_(
                pc.match_substring(texts, "  "),
                pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, ""))),
            )
            if pc.any(odd).as_py():
                lists = [chunks_of(text) for text in texts.to_pylist()]
                per_text = np.fromiter(map(len, lists), np.int64, len(lists))
                chunks = pa.array([chunk for chunks in lists for chunk in chunks], pa.string())
            else:
                split = pc.split_pattern(texts, " ")
                per_text, chunks = np.asarray(pc.list_value_length(split), dtype=np.int64), split.flatten()
            table.begin()
            coded = chunks.dictionary_encode()
            rows = table.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            ids, lengths = table.join(rows[np.asarray(coded.indices)], per_text)
            ends = np.cumsum(lengths)
            each = [ids[end - length : end] for end, length in zip(ends.tolist(), lengths.tolist())]
        else:
            each = [np.array(ids, np.int32) for ids in sp.encode(texts.to_pylist(), num_threads=1)]
        yield batch.column("doc_id"), [np.concatenate([head, ids, tail]) for ids in each]


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", bounds: bool = True) -> DataFrame:
    """(doc_id, ids): the ids of each text, with begin and end ids if ``bounds``.

    A row for each row of ``df``: NULL texts are encoded as empty ones, identifiers are carried
    along (NULL and repeats included), other columns are ignored, and a text of any length is one list.
    """
    rows = texts_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, each in encoded(batches, model, bounds):
            yield pa.RecordBatch.from_arrays([doc_ids, _lists(each)], ["doc_id", "ids"])

    return rows.mapInArrow(run, schema_of(rows.select("doc_id"), "ids array<int>"))


def _lists(each: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in each])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each) if each else np.empty(0, np.int32)))


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each list of ids, by the library; NULL lists are empty."""
    rows = df.select(col(id_col).alias("doc_id"), col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [processor(model).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, schema_of(rows.select("doc_id"), "text string"))


def digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encoded, decoded and digested in one pass."""
    rows = texts_of(df, id_col, text_col)
    more = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema = schema_of(rows.select("doc_id"), more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for doc_ids, each in encoded(batches, model):
            texts = [sp.decode(ids.tolist()) for ids in each]
            columns = [
                doc_ids,
                pa.array([len(ids) for ids in each], pa.int64()),
                pa.array([hashlib.sha256(ids.astype("<u4")).hexdigest() for ids in each]),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for text in texts]),
            ]
            yield pa.RecordBatch.from_arrays(columns + [_lists(each)] * with_ids, schema.names)

    return rows.mapInArrow(run, schema)
