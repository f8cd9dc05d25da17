"""Shards by a k-d tree: weighted medians along the widest metadata dimension.

The root holds all rows. A node that stands for k shards is cut in two, for k // 2 and the rest, where
the running bytes along its widest dimension (relative to the whole table's extent) reach their
share; leaves stand for one shard and so hold about total / shards bytes. Rows that agree in a
dimension are ordered by a hash of their text and then by a row number, so a cut can be made anywhere.

Cuts are found without moving rows: each pass is one aggregate of bytes by (node, bin of the key's
range) over the narrow staged table, for all nodes of a level at once, and narrows the range; once
a range holds at most ``finish_rows`` rows, those are read and cut exactly. What reaches the driver
is a few rows for each node. The tree, of shards - 1 cuts, is an expression over the columns.

Equal texts are one point, that of their smallest identifier, and so lie together; a cut that falls
inside them is moved to their border where that costs at most ``tolerance`` of a shard's bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import col, join_split, stage

SHARDS = 24
BINS = 1 << 12
FINISH_ROWS = 1 << 12
TOLERANCE = 0.05
#: Rows in one window of the numbering, about.
SLOT_ROWS = 50_000


@dataclass
class Node:
    """``shards`` from ``first`` on. Inner nodes: rows whose (dimension, mark, row) is below cut go left."""

    first: int
    shards: int
    dimension: int = 0
    cut: tuple[int, int, int] | None = None
    left: Node | None = None
    right: Node | None = None

    def place(self) -> Column:
        """The first shard of the lowest node that a row falls into."""
        if self.cut is None:
            return F.lit(self.first)
        d, mark, row = self.cut
        value = F.col(f"d{self.dimension}")
        below = (value < d) | (
            (value == d) & ((F.col("mark") < mark) | ((F.col("mark") == mark) & (F.col("row") < row)))
        )
        return F.when(below, self.left.place()).otherwise(self.right.place())

    def leaves(self) -> list[Node]:
        return [self] if self.cut is None else self.left.leaves() + self.right.leaves()


def coordinate(column: Column, kind: T.DataType) -> Column:
    """A whole number that keeps the order: of numbers (halved), or of the first seven bytes of a text."""
    if isinstance(kind, T.StringType):
        head = F.substring(F.encode(F.coalesce(column, F.lit("")), "UTF-8"), 1, 7)
        return F.conv(F.rpad(F.hex(head), 14, "0"), 16, 10).cast("bigint")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return F.shiftright(F.coalesce(column.cast("bigint"), F.lit(0).cast("bigint")), 1)
    raise TypeError(f"no dimension of type {kind.simpleString()}: give whole numbers or texts")


def points(df: DataFrame, dimensions: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """The staged narrow table: row, doc_id, size, text_crc32, mark and a coordinate for each dimension."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    names = [f"d{i}" for i in range(len(dimensions))]
    rows = df.select(
        F.monotonically_increasing_id().alias("row"),
        col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("mark"),
        *[coordinate(col(c), df.schema[c].dataType).alias(n) for c, n in zip(dimensions, names)],
    )
    same = ["mark", "size", "text_crc32"]
    first = rows.groupBy(*same).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", *names)).alias("first")
    )
    return stage(
        join_split(rows.drop(*names), first, same).select("row", "doc_id", *same, *[f"first.{n}" for n in names]), "points"
    )


def _inside(wanted: dict[int, dict]) -> Column:
    """Rows in the range that is still open for their node's cut."""
    out = F.lit(False)
    for n, w in wanted.items():
        here = F.col("node") == n
        for name, low, high in w["fixed"]:
            here &= F.col(name).between(low, high)
        out |= here
    return out


def _narrow(rows: DataFrame, wanted: dict[int, dict], bins: int) -> None:
    """One pass: for each node the bin of its key's range in which its target lies."""
    ranges = rows.sparkSession.createDataFrame(
        [(n, w["key"], w["low"], w["step"]) for n, w in wanted.items()], "node int, key string, low bigint, step bigint"
    )
    keys = sorted({w["key"] for w in wanted.values()})
    value = F.coalesce(*[F.when(F.col("key") == k, F.col(k)) for k in keys])
    found = (
        rows.filter(_inside(wanted))
        .join(F.broadcast(ranges), "node")
        .groupBy("node", F.floor((value - F.col("low")) / F.col("step")).cast("int").alias("bin"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    )
    before = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    targets = rows.sparkSession.createDataFrame([(n, w["target"]) for n, w in wanted.items()], "node int, target bigint")
    hit = (
        found.withColumn("earlier", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        .join(F.broadcast(targets), "node")
        .filter("earlier < target AND target <= earlier + bytes")
    )
    for row in hit.collect():
        w = wanted[row["node"]]
        low = w["low"] + row["bin"] * w["step"]
        w["target"] -= row["earlier"]
        w["rows"] = row["rows"]
        w["fixed"] = w["fixed"][:-1] + [(w["key"], low, low + w["step"] - 1)]
        w["low"] = low


def _exact(found: list, target: int, slack: float, whole_groups: bool) -> tuple[tuple[int, int, int], int]:
    """The first key not to go left, and the bytes that do, among sorted (d, mark, row, size)."""
    done, best = 0, None
    for (d, mark), group in groupby(found, key=lambda r: (r[0], r[1])):
        group = list(group)
        total = sum(r[3] for r in group)
        if done + total >= target:
            if whole_groups:
                low, high = target - done, done + total - target
                if min(low, high) <= slack:
                    after = (d, mark, group[-1][2] + 1)
                    return ((d, mark, group[0][2]), done) if low <= high else (after, done + total)
            for r in group:
                # The row goes left if that leaves the cut nearer to the target.
                if 2 * (target - done) <= r[3]:
                    return (d, mark, r[2]), done
                done += r[3]
            return (d, mark, group[-1][2] + 1), done
        done += total
        best = (d, mark, group[-1][2] + 1)
    return best or (0, 0, 0), done


def kd_tree(
    rows: DataFrame, dimensions: int, shards: int, bins: int, finish_rows: int, tolerance: float
) -> tuple[Node, int]:
    """The tree over the points, and their number."""
    root, count, extent, leaf_bytes = Node(0, shards), 0, {}, 0.0
    keys = [f"d{i}" for i in range(dimensions)] + ["mark", "row"]
    while True:
        open_nodes = {n.first: n for n in root.leaves() if n.shards > 1}
        placed = rows.withColumn("node", root.place())
        if not open_nodes and count:
            return root, count
        stats = placed.groupBy("node").agg(
            F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[F.struct(F.min(k), F.max(k)).alias(k) for k in keys]
        ).collect()
        if not count:
            if not stats:
                return root, 0
            count, leaf_bytes = stats[0]["rows"], stats[0]["bytes"] / shards
            extent = {k: max(1, stats[0][k][1] - stats[0][k][0]) for k in keys}
            if not open_nodes:
                return root, count
        wanted: dict[int, dict] = {}
        for s in stats:
            node = open_nodes.get(s["node"])
            if node is None:
                continue
            node.dimension = max(range(dimensions), key=lambda i: ((s[f"d{i}"][1] - s[f"d{i}"][0]) / extent[f"d{i}"], -i))
            order = [f"d{node.dimension}", "mark", "row"]
            wanted[s["node"]] = {
                "target": max(1, round(s["bytes"] * (node.shards // 2) / node.shards)),
                "rows": s["rows"],
                "ranges": {k: tuple(s[k]) for k in order},
                "order": order,
                "fixed": [(order[0], *s[order[0]])],
            }
        going = {n: w for n, w in wanted.items() if w["rows"] > finish_rows}
        while going:
            for w in going.values():
                name, low, high = w["fixed"][-1]
                if low == high and len(w["fixed"]) < 3:
                    name = w["order"][len(w["fixed"])]
                    low, high = w["ranges"][name]
                    w["fixed"] = w["fixed"] + [(name, low, high)]
                w["key"], w["low"], w["step"] = name, low, -(-(high - low + 1) // bins)
            _narrow(placed, going, bins)
            going = {n: w for n, w in going.items() if w["rows"] > finish_rows}
        near: dict[int, list] = {n: [] for n in wanted}
        if wanted:
            for row in placed.filter(_inside(wanted)).select("node", "size", *keys).collect():
                near[row["node"]].append((row[f"d{open_nodes[row['node']].dimension}"], row["mark"], row["row"], row["size"]))
        for first, node in open_nodes.items():
            w = wanted.get(first)
            node.cut = (0, 0, 0)
            if w:
                node.cut, _ = _exact(sorted(near[first]), w["target"], tolerance * leaf_bytes, len(w["fixed"]) < 3)
            half = node.shards // 2
            node.left, node.right = Node(first, half), Node(first + half, node.shards - half)


def kd_shards(
    df: DataFrame,
    dimensions: Sequence[str] = ("n_chars", "lang", "source", "doc_id"),
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bins: int = BINS,
    finish_rows: int = FINISH_ROWS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; a row for each row of ``df``.

    size is the UTF-8 length of the text (NULL: none) plus 8, and the shards' sizes are near equal:
    each cut misses its share by half a document, or by ``tolerance`` of a shard to keep equal
    texts together. slot counts the rows of a shard from 0 without gaps. Dimensions are columns of
    whole numbers or texts; NULL counts as 0 or as the empty text. Rows may repeat in everything,
    identifiers may be NULL; with fewer rows than shards some shards are empty.
    """
    if shards < 1 or not dimensions:
        raise ValueError("at least one shard and one dimension are needed")
    rows = points(df, dimensions, id_col, text_col)
    tree, count = kd_tree(rows, len(dimensions), shards, bins, finish_rows, tolerance)
    buckets = max(1, -(-count // (shards * SLOT_ROWS)))
    placed = rows.select(
        "row", "doc_id", "size", "text_crc32", tree.place().cast("int").alias("shard"),
        F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("rows"))
        .select("shard", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    )
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row"))
    return (
        placed.withColumn("number", number)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("number") - 1).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
