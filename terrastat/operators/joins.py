"""Equi-joins against dimension tables.

None of these forces a broadcast: Spark broadcasts a side when its file size, or its measured
size once AQE has run the stage, is under ``spark.sql.autoBroadcastJoinThreshold``, and otherwise
uses a sort-merge join that AQE splits where a key is hot. Reports aggregate before they join, so
what meets a dimension is one row per area.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.literal import literal_table


def lookup(df: DataFrame, dimension: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner join on one or several key columns; rows with an unknown or NULL key are dropped."""
    return df.join(dimension, [on] if isinstance(on, str) else list(on))


def left_chain(spine: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left-join every table in ``others`` to a complete spine; what is missing stays NULL."""
    for other in others:
        spine = spine.join(other, list(on), "left")
    return spine


def star(first: DataFrame, others: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Inner-join already aggregated tables on the same key."""
    for other in others:
        first = lookup(first, other, on)
    return first


def remap_by_table(
    df: DataFrame, moved: DataFrame, *, region: str, area: str, new_area: str
) -> DataFrame:
    """Replace ``area`` by ``new_area`` where ``moved`` lists the (region, area) pair.

    A pair that ``moved`` lists more than once gets the smallest of its new numbers, so rows never
    multiply.
    """
    target = moved.groupBy(region, area).agg(F.min(new_area).alias("_new_area"))
    return df.join(target, [region, area], "left").select(
        *[F.coalesce("_new_area", area).alias(c) if c == area else F.col(f"`{c}`") for c in df.columns]
    )


def remap(
    df: DataFrame, moved: Mapping[tuple[int, int], int], *, region: str, area: str
) -> DataFrame:
    """:func:`remap_by_table` for pairs given as ``{(region, area): new area}``, however many."""
    schema = T.StructType(
        [
            T.StructField(region, df.schema[region].dataType),
            T.StructField(area, df.schema[area].dataType),
            T.StructField("_moved_to", df.schema[area].dataType),
        ]
    )
    table = literal_table(df.sparkSession, [(*old, new) for old, new in moved.items()], schema)
    return remap_by_table(df, table, region=region, area=area, new_area="_moved_to")
