"""Running totals in a global order, by dealing rows out in ranges.

Rows are dealt to parts by ranges of their order, so a part's rows stand between those of its
neighbours, and written once: a part is then the same for every reader, and no task ever holds more
than one part. What crosses part borders is one total for each part. With the parts as the unit, a
running total needs no window that grows with the table: one over the rows of each part, and one over
as many rows as there are parts, which the session's shuffle setting bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import stage

PART = "_part"


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt_by_range(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``, which ascends in ``order``: dealt out by range and written.

    Rows that are equal in ``order`` share a part, so the order should tell rows apart.
    """
    return stage(_dealt(df, order, parts))


def _dealt(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    return df.repartitionByRange(parts or shuffle_parts(df), *order).withColumn(PART, F.spark_partition_id())


def part_starts(dealt: DataFrame, amount: str, name: str) -> DataFrame:
    """(_part, name): the sum of ``amount`` over all earlier parts, a row for each part."""
    totals = dealt.groupBy(PART).agg(F.sum(amount).alias("_total"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(PART, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(name))


def total_before(df: DataFrame, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """``df`` and the sum of ``amount`` (whole numbers) over all rows before each in ``order``.

    ``order`` must tell rows apart. NULLs come first.
    """
    dealt = dealt_by_range(df, [F.col(c) for c in order])
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    # As many rows as the shuffle has parts.
    starts = F.broadcast(part_starts(dealt, amount, "_start"))
    return own.join(starts, PART).withColumn(name, F.col("_start") + F.col("_own")).drop(PART, "_own", "_start")
