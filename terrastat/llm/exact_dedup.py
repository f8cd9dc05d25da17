"""Exact deduplication by Patricia-trie owners.

Every text is inserted, with all its bytes, into a compressed radix trie whose terminal nodes hold
the smallest identifier and the number of rows. Tries work at two places:

* beside the scan, over the rows of one task: copies meet before anything is shuffled, so a text
  that a third of all rows repeat leaves one row a task;
* at the owner: the remaining texts are dealt out by length and content hash, and reach the owner's
  trie in byte order.

Both tries hold at most about ``budget`` bytes, nodes and members included, and spill by subtree.
Beside the scan the heaviest subtrees go (a copy that comes later starts a new row, which the owner
unites), and of a text's copies only the smallest identifier and the number stay: the others are
given out as they come. At the owner everything left of the path to the newest string is complete,
because strings come in byte order, and goes for good. Equality is that of the bytes; the hash only
deals out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import col, fresh, pieces, rows_with_keys, shuffle_parts, stage

SPACES = r"[\x20\x09-\x0D]+"
#: Bytes that a trie holds before it spills; what a node and a member take besides the text.
TRIE_BYTES = 32 << 20
NODE_BYTES, MEMBER_BYTES = 300, 150


class Node:
    __slots__ = ("label", "children", "best", "count", "members", "first")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.best = None
        self.count = 0
        self.members: list = []
        self.first = None


def common_length(a: bytes, a_from: int, b: bytes, b_from: int) -> int:
    """How many bytes agree from the two positions on: halving, each compare in C."""
    low, high = 0, min(len(a) - a_from, len(b) - b_from)
    while low < high:
        middle = (low + high + 1) // 2
        if a[a_from + low : a_from + middle] == b[b_from + low : b_from + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A compressed radix trie of byte strings; ``size`` counts labels, nodes and members."""

    def __init__(self):
        self.root = Node(b"")
        self.size = 0

    def terminal(self, text: bytes) -> Node:
        """The node of ``text``, which is put in if it is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                node.children[text[at]] = child
                self.size += len(child.label) + NODE_BYTES
                return child
            if not text.startswith(child.label, at):
                k = common_length(child.label, 0, text, at)
                middle = Node(child.label[:k])
                middle.children[child.label[k]] = child
                node.children[text[at]] = middle
                child.label = child.label[k:]
                child = middle
                self.size += NODE_BYTES
            node, at = child, at + len(child.label)
        return node

    def insert(self, text: bytes, key, count: int, member) -> None:
        node = self.terminal(text)
        self.size += MEMBER_BYTES
        if node.best is None or key < node.best:
            node.best = key
        node.count += count
        node.members.append(member)

    def _cut(self, prefix: bytes, node: Node) -> Iterator[tuple[bytes, Node]]:
        """All terminals of a subtree that was taken out."""
        todo = [(prefix, node)]
        while todo:
            prefix, node = todo.pop()
            text = prefix + node.label
            self.size -= len(node.label) + NODE_BYTES * (node is not self.root) + MEMBER_BYTES * len(node.members)
            if node.best is not None:
                yield text, node
            todo.extend((text, child) for child in node.children.values())

    def spill_heaviest(self, keep: int) -> Iterator[tuple[bytes, Node]]:
        """Take out whole subtrees, the heaviest first, until ``keep`` bytes are left at most."""
        prefix, node = b"", self.root
        while node.best is None and len(node.children) == 1:
            (child,) = node.children.values()
            prefix, node = prefix + node.label, child
        if not node.children:
            yield from self.drain()
            return
        weight = {first: self._weight(child) for first, child in node.children.items()}
        for first in sorted(weight, key=lambda first: (-weight[first], first)):
            if self.size <= keep:
                break
            yield from self._cut(prefix + node.label, node.children.pop(first))

    @staticmethod
    def _weight(node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            node = todo.pop()
            total += len(node.label) + NODE_BYTES + MEMBER_BYTES * len(node.members)
            todo.extend(node.children.values())
        return total

    def spill_complete(self, newest: bytes) -> Iterator[tuple[bytes, Node]]:
        """Take out all that byte order says is complete: what isn't on the path to ``newest``."""
        node, at = self.root, 0
        while at < len(newest):
            path = newest[at]
            for first in [first for first in node.children if first != path]:
                yield from self._cut(newest[:at], node.children.pop(first))
            node = node.children[path]
            at += len(node.label)
            if at < len(newest) and node.best is not None:
                done, node.best = Node(b""), None
                done.best, done.count, done.members = True, node.count, node.members
                node.count, node.members = 0, []
                self.size -= MEMBER_BYTES * len(done.members)
                yield newest[:at], done

    def drain(self) -> Iterator[tuple[bytes, Node]]:
        root = self.root
        yield from self._cut(b"", root)
        self.root = Node(b"")


def _rows(found: Iterator[tuple], schema: pa.Schema, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``limit`` bytes."""
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES
) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of space and 0x09-0x0D by one space;
    the row with the smallest identifier stays. NULL text counts as empty. A NULL identifier comes
    after all others (``keep_id`` is NULL only where all are). Of rows that share the smallest
    identifier exactly one is kept. An empty table gives an empty result; other columns, whatever
    their names, are not looked at.
    """
    id_type = df.select(col(id_col)).schema[0].dataType
    normal = F.regexp_replace(F.coalesce(col(text_col).cast("string"), F.lit("")), SPACES, " ")
    rows = df.select(col(id_col).alias("doc_id"), normal.cast("binary").alias("text"))
    met_schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", id_type),
            T.StructField("local_row", T.LongType()),
            T.StructField("text", T.BinaryType()),
            T.StructField("copies", T.LongType()),
        ]
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, next_row = PatriciaTrie(), TaskContext.get().partitionId() << 40
        schema = None

        def told(spilled):
            for text, node in spilled:
                missing, doc_id, row = node.best
                yield row, None if missing else doc_id, node.first, text, node.count

        for batch in pieces(batches):
            schema = schema or pa.schema(
                [("row", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("local_row", pa.int64()), ("text", pa.binary()), ("copies", pa.int64())]
            )
            copies = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                key = (True, 0, next_row) if doc_id is None else (False, doc_id, next_row)
                node = trie.terminal(text)
                if node.best is None:
                    node.best, node.first = key, next_row
                else:
                    (missing, other, row), node.best = max(key, node.best), min(key, node.best)
                    copies.append((row, None if missing else other, node.first, None, None))
                node.count += 1
                next_row += 1
            yield from _rows(iter(copies), schema)
            if trie.size > budget:
                yield from _rows(told(trie.spill_heaviest(budget // 2)), schema)
        if schema:
            yield from _rows(told(trie.drain()), schema)

    met = stage(rows.mapInArrow(meet, met_schema), "exact-dedup")

    owner_schema = T.StructType(
        [
            T.StructField("local_row", T.LongType()),
            T.StructField("keep_row", T.LongType()),
            T.StructField("keep_id", id_type),
            T.StructField("group_size", T.LongType()),
            T.StructField("text_sha256", T.StringType()),
        ]
    )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, newest, schema = PatriciaTrie(), b"", None

        def told(spilled):
            for text, node in spilled:
                missing, keep_id, keep_row = min(key for key, _, _ in node.members)
                digest = hashlib.sha256(text).hexdigest()
                size = sum(copies for _, copies, _ in node.members)
                for _, _, local_row in node.members:
                    yield local_row, keep_row, None if missing else keep_id, size, digest

        for batch in pieces(batches):
            schema = schema or pa.schema(
                [("local_row", pa.int64()), ("keep_row", pa.int64()), ("keep_id", batch.schema.field("doc_id").type), ("group_size", pa.int64()), ("text_sha256", pa.string())]
            )
            columns = (batch.column(c).to_pylist() for c in ("row", "doc_id", "local_row", "text", "copies"))
            for row, doc_id, local_row, text, copies in zip(*columns):
                key = (True, 0, row) if doc_id is None else (False, doc_id, row)
                trie.insert(text, key, copies, (key, copies, local_row))
                newest = text
            if trie.size > budget:
                yield from _rows(told(trie.spill_complete(newest)), schema)
        if schema:
            yield from _rows(told(trie.drain()), schema)

    owners = (
        met.filter("text IS NOT NULL")
        .select("row", "doc_id", "local_row", "text", "copies")
        .repartition(shuffle_parts(df.sparkSession), F.length("text"), F.xxhash64("text"))
        .sortWithinPartitions("text")
        .mapInArrow(own, owner_schema)
    )
    return (
        met.select("row", "doc_id", "local_row")
        .join(owners, "local_row")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("row") == F.col("keep_row")).alias("kept"),
            "text_sha256",
        )
    )


def first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_dedup` keeps, with all their columns.

    Rows that repeat both identifier and text are one row.
    """
    text = fresh(df, "normal_text")
    normal = df.withColumn(text, F.regexp_replace(F.coalesce(col(text_col).cast("string"), F.lit("")), SPACES, " "))
    keys = exact_dedup(df, id_col, text_col).filter("kept").select(
        F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256").alias("row_key")
    )
    return rows_with_keys(normal, id_col, text, keys).select(*[col(c) for c in df.columns])
