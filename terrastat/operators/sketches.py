"""Estimates from mergeable sketches, for those who ask for them.

The exact operators (:func:`~terrastat.operators.aggregates.distinct_with_totals`,
:func:`~terrastat.operators.quantiles.group_quantiles`) stay the default; nothing here is chosen by
the size of a table. A sketch has a fixed size, is filled beside the scan and merges: what reaches
the shuffle is a sketch for each area and task, and the totals of wider areas are merged from the
sketches of the areas, without a second look at the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import is_missing
from .aggregates import unfold_totals, with_totals

#: Buckets of a distinct sketch (as a power of two) and size parameter of a quantile sketch.
LOG_BUCKETS = 12
QUANTILE_SIZE = 200

_HASHED_AS_THEY_ARE = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def distinct_error(log_buckets: int = LOG_BUCKETS) -> float:
    """Relative standard error of a distinct count, also of one that was merged."""
    return 1.04 / math.sqrt(1 << log_buckets)


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """How far the rank of a quantile is off at most in 99 of 100 cases, as a share of the points.

    The published figure of the sketch; merging does not make it larger.
    """
    return 2.296 / size**0.9723


def _hashable(df: DataFrame, value: str) -> Column:
    """Values of other types by their text, so that equal values have equal texts."""
    kind = df.schema[value].dataType
    if isinstance(kind, _HASHED_AS_THEY_ARE):
        return F.col(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.col(value) + F.lit(0.0)).cast("string")  # -0.0 equals 0.0
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise TypeError(f"{value}: distinct values of {kind.simpleString()} are not sketched")
    return F.col(value).cast("string")


def distinct_sketches(
    df: DataFrame, by: Sequence[str], value: str, *, log_buckets: int = LOG_BUCKETS
) -> DataFrame:
    """(by, sketch): a sketch of the distinct non-NULL values of each group, of fixed size."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(_hashable(df, value), log_buckets).alias("sketch"))


def estimated_distinct_with_totals(
    df: DataFrame,
    *,
    region: str,
    area: str,
    value: str,
    name: str,
    total_regions: Sequence[int],
    total_label,
    log_buckets: int = LOG_BUCKETS,
) -> DataFrame:
    """Estimate of :func:`~terrastat.operators.aggregates.distinct_with_totals`.

    The rows are read once and none is repeated: the totals are merged from the sketches of their
    areas. The standard error is :func:`distinct_error`; a group without values counts zero.
    """
    sketches = distinct_sketches(df, [region, area], value, log_buckets=log_buckets)
    merged = (
        with_totals(sketches, region, area, total_regions, total_label, ["sketch"])
        .groupBy(region, area)
        .agg(
            F.count_if(~F.col("_total")).alias("_details"),
            F.count_if("_total").alias("_totals"),
            F.hll_union_agg(F.when(~F.col("_total"), F.col("sketch"))).alias("_detail"),
            F.hll_union_agg(F.when(F.col("_total"), F.col("sketch"))).alias("_total_value"),
        )
        .withColumns({c: F.hll_sketch_estimate(c) for c in ("_detail", "_total_value")})
    )
    return unfold_totals(merged, region, area, name)


def quantile_sketches(
    points: DataFrame, by: Sequence[str], value: str, *, size: int = QUANTILE_SIZE
) -> DataFrame:
    """(by, sketch): a sketch of the numbers of each group; NULL and NaN are no points.

    A larger ``size`` is more exact (:func:`rank_error`). Sketches of the same points differ a little
    from run to run.
    """
    numbers = points.where(~is_missing(F.col(value)))
    return numbers.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch")
    )


def merge_quantile_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, sketch): the sketches of narrower groups as those of wider ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def estimated_quantiles(sketches: DataFrame, quantiles: Mapping[str, float]) -> DataFrame:
    """The groups, ``points`` (exact) and each quantile by its name, read off the sketches.

    A quantile is one of the points, there is no interpolation.
    """
    groups = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(
        *groups,
        F.kll_sketch_get_n_double("sketch").alias("points"),
        *[
            F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))).alias(name)
            for name, share in quantiles.items()
        ],
    )
