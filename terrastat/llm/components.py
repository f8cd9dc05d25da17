"""Connected components of links between 64-bit nodes, by alternating large and small stars.

Each round is plain joins and grouped minima, so a node with very many links is combined on the map
side and its join is split like any skewed join. Rounds are cut by written tables; only a count
and a checksum of the links come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_split, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return (
        join_split(both.filter("b > a"), least, ["a"])
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = join_split(down, least, ["a"]).filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).first()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b; both bigint): root is the smallest reachable.

    Links may repeat and point either way; a link of a node with itself says nothing. Nodes without
    a link do not appear.
    """
    links = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        links = stage(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == state:
            break
        state = after
    members = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(links.select("b", "b").distinct().toDF("node", "root"))
