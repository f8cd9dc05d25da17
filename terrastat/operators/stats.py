"""The numbers behind the charts: counts, fits, distributions and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import is_missing
from .quantiles import dealt_counts, frequencies, group_quantiles, read_quantiles


def linear_fit(points: DataFrame, *, series: str, x: str, y: str) -> DataFrame:
    """Least-squares line and R² per series, over the points that have both coordinates (not NaN).

    Constant y gives R² 1, constant x or a single point gives NULLs. ``x_min`` and ``x_max``
    delimit the line.
    """
    return (
        points.where(~is_missing(F.col(x)) & ~is_missing(F.col(y)))
        .groupBy(series)
        .agg(
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"),
            F.min(x).alias("x_min"),
            F.max(x).alias("x_max"),
            F.count(F.lit(1)).alias("points"),
        )
    )


def fit_line_points(fit: DataFrame, *, series: str, n: int = 1000) -> DataFrame:
    """``n`` evenly spaced points of each fitted line, from its x_min to its x_max."""
    step = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("i") / max(n - 1, 1)
    return (
        fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
        .withColumn("x", step)
        .select(series, "i", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y"))
    )


def scatter_points(
    points: DataFrame,
    *,
    x: str,
    y: str,
    x_view: tuple[float, float],
    y_view: tuple[float, float],
) -> DataFrame:
    """All points, with ``in_view`` telling which ones a cropped chart shows."""
    return points.withColumn("in_view", F.col(x).between(*x_view) & F.col(y).between(*y_view))


_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_REACH = 1.5


def _fences() -> tuple[Column, Column]:
    spread = (F.col("q3") - F.col("q1")) * _REACH
    return F.col("q1") - spread, F.col("q3") + spread


def box_stats(points: DataFrame, *, group: str, value: str) -> DataFrame:
    """Box-plot numbers per group.

    A whisker ends at the furthest value within 1.5 interquartile ranges of the box, and never
    inside the box.
    """
    dealt = dealt_counts(frequencies(points, group, value), group, value, list(_QUARTILES.values()))
    low, high = _fences()
    v, n = F.col("_v"), F.col("_n")
    quartiles = read_quantiles(dealt, group, _QUARTILES)
    boxes = (
        _join_group(dealt.drop("points"), quartiles, group)
        .groupBy(group, "points", *_QUARTILES)
        .agg(
            F.min(F.when(v >= low, v)).alias("_low"),
            F.max(F.when(v <= high, v)).alias("_high"),
            F.coalesce(F.sum(F.when((v < low) | (v > high), n)), F.lit(0)).alias("outliers"),
        )
    )
    return boxes.select(
        group,
        "points",
        *_QUARTILES,
        F.least("q1", F.col("_low").cast("double")).alias("whisker_low"),
        F.greatest("q3", F.col("_high").cast("double")).alias("whisker_high"),
        "outliers",
    )


def _join_group(rows: DataFrame, of_group: DataFrame, group: str) -> DataFrame:
    """Inner join on the group, which may be NULL."""
    other = of_group.withColumnRenamed(group, "_group")
    return rows.join(other, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def box_outliers(
    points: DataFrame, *, group: str, value: str, keep: Sequence[str] = ()
) -> DataFrame:
    """The points beyond the whiskers, one row each."""
    quartiles = group_quantiles(points, group=group, value=value, quantiles=_QUARTILES)
    low, high = _fences()
    v = F.col(value)
    far = ((v < low) | (v > high)) & ~is_missing(v)
    return _join_group(points, quartiles, group).where(far).select(group, *keep, value)


def rate_per_thousand(counts: str, population: str) -> Column:
    """Count per 1000 inhabitants; NULL where nobody lives."""
    return F.try_divide(F.col(counts) * 1000, F.col(population))
