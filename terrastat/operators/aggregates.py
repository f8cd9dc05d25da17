"""Grouped aggregates of the reports.

All of them are sums, counts and maxima that Spark combines on the map side, so an area with a
third of all rows costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Band:
    """Values in (above, up_to]. ``None`` leaves a side open, a Column varies by row."""

    name: str
    above: int | Column | None = None
    up_to: int | Column | None = None

    def holds(self, value: Column) -> Column:
        low = F.lit(True) if self.above is None else value > self.above
        high = F.lit(True) if self.up_to is None else value <= self.up_to
        return low & high


def edge_by_region(region: str, groups: Mapping[int, Sequence[int]]) -> Column:
    """Band edge that depends on the row's region: ``{edge: regions}``; NULL for other regions.

    A region listed under two edges is refused, it would have two answers.
    """
    regions = [r for members in groups.values() for r in members]
    if len(regions) != len(set(regions)):
        raise ValueError("a region is listed under two band edges")
    if not groups:
        return F.lit(None).cast("int")
    cases = " ".join(
        f"WHEN `{region}` IN ({', '.join(map(str, members))}) THEN {edge}"
        for edge, members in groups.items()
    )
    return F.expr(f"CASE {cases} END")


def band_sums(
    df: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    amount: str,
    bands: Sequence[Band],
    highest: int | None = None,
) -> DataFrame:
    """Sum ``amount`` over each band of ``value`` per key, in one scan of ``df``.

    A key is kept only if every band has at least one row, whatever the rows' amounts are (as
    when one aggregate per band is inner-joined). ``highest`` is a value that no band reaches
    beyond; it becomes a filter that the scan can use.
    """
    holds = [band.holds(F.col(value)) for band in bands]
    rows = df if highest is None else df.where(F.col(value) <= highest)
    sums = [F.sum(F.when(h, F.col(amount))).alias(b.name) for h, b in zip(holds, bands)]
    found = [F.count_if(h).alias(f"_found_{i}") for i, h in enumerate(holds)]
    out = rows.groupBy(*keys).agg(*sums, *found)
    for i in range(len(bands)):
        out = out.where(F.col(f"_found_{i}") > 0)
    return out.select(*keys, *[b.name for b in bands])


def region_edges(edges: DataFrame, region: str, edge: str) -> DataFrame:
    """The (region, edge) rows of a configuration table, one a region.

    Repeated rows are one; a region with two different edges fails the job and is named, it would
    have two answers. Rows without a region or an edge say nothing.
    """
    said = edges.where(F.col(region).isNotNull() & F.col(edge).isNotNull())
    twice = F.concat(
        F.lit("two band edges for region "),
        F.col(region).cast("string"),
        *[part for c in ("_least", "_most") for part in (F.lit(", "), F.col(c).cast("string"))],
    )
    return (
        said.groupBy(region)
        .agg(F.min(edge).alias("_least"), F.max(edge).alias("_most"))
        .select(
            region,
            F.when(F.col("_least") == F.col("_most"), F.col("_least"))
            .otherwise(F.raise_error(twice))
            .alias(edge),
        )
    )


def regions_without_edge(df: DataFrame, edges: DataFrame, region: str, edge: str) -> DataFrame:
    """The regions of ``df`` that the table gives no edge; a NULL region is one of them."""
    known = region_edges(edges, region, edge)
    return df.select(region).distinct().join(known, region, "left_anti")


def band_sums_by_table(
    df: DataFrame,
    keys: Sequence[str],
    edges: DataFrame,
    *,
    region: str,
    edge: str,
    value: str,
    amount: str,
    bands: Callable[[Column], Sequence[Band]],
    highest: int | None = None,
) -> DataFrame:
    """:func:`band_sums` with an edge that a table (region, edge) gives each region.

    ``bands`` makes the bands from the edge's column; ``region`` is one of the keys. The rows are
    summed per key and value first, and the table, which may have any number of regions, meets
    these sums instead of the rows: a hot region is one row for each of its values. A region
    without an edge is in no band that has one, see :func:`regions_without_edge`.
    """
    if region not in keys:
        raise ValueError(f"{region} is not one of the keys")
    if edge in df.columns:
        raise ValueError(f"{edge} is a column of the rows as well")
    sums = df.groupBy(*keys, value).agg(F.sum(amount).alias(amount))
    rows = sums.join(region_edges(edges, region, edge), region, "left")
    return band_sums(rows, keys, value=value, amount=amount, bands=bands(F.col(edge)), highest=highest)


def level_pivot(
    establishments: DataFrame,
    bridge: DataFrame,
    *,
    key: str,
    type_col: str,
    by: Sequence[str],
    levels: Mapping[str, Sequence[int]],
    keep_empty: bool = False,
) -> DataFrame:
    """Count (establishment, type) pairs per area, one column per level.

    An establishment with two types of one level counts twice. Those without any type are left
    out unless ``keep_empty``, which gives them zero.

    The bridge is reduced to one row per key before the join. Both use the same hash
    partitioning, so that costs no extra shuffle, and a key repeated in the bridge meets its
    establishment as one row.
    """
    per_key = bridge.groupBy(key).agg(
        *[
            F.count_if(F.col(type_col).isin(*types)).alias(level)
            for level, types in levels.items()
        ]
    )
    joined = establishments.select(key, *by).join(
        per_key, key, "left" if keep_empty else "inner"
    )
    return joined.groupBy(*by).agg(
        *[F.coalesce(F.sum(level), F.lit(0)).alias(level) for level in levels]
    )


def count_rows(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def count_above(
    df: DataFrame, by: Sequence[str], *, value: str, threshold: float, name: str
) -> DataFrame:
    """Rows per key with ``value`` above the threshold; NULL and NaN are not above."""
    high = df.where(F.col(value) > threshold).where(~F.isnan(F.col(value).cast("double")))
    return count_rows(high, by, name)


def with_totals(
    df: DataFrame,
    region: str,
    area: str,
    regions: Sequence[int],
    label,
    others: Sequence[str],
) -> DataFrame:
    """Repeat the rows of the listed regions under the total's label; other rows pass once."""
    detail = F.struct(F.col(area).alias(area), F.lit(False).alias("_total"))
    label = F.lit(label).cast(df.schema[area].dataType)
    total = F.struct(label.alias(area), F.lit(True).alias("_total"))
    return df.select(
        region,
        *others,
        F.inline(
            F.when(F.col(region).isin(*regions), F.array(detail, total)).otherwise(
                F.array(detail)
            )
        ),
    )


def unfold_totals(grouped: DataFrame, region: str, area: str, name: str) -> DataFrame:
    """One row for the detail and one for the total of an area, or one where they are equal.

    A region's total shares a group with details only if its label is a real area.
    """
    values = F.expr(
        "array_distinct(transform(filter(array("
        "struct(_details > 0 AS found, _detail AS value),"
        "struct(_totals > 0 AS found, _total_value AS value)), v -> v.found), v -> v.value))"
    )
    return grouped.select(region, area, F.explode(values).alias(name))


def distinct_with_totals(
    df: DataFrame,
    *,
    region: str,
    area: str,
    value: str,
    name: str,
    total_regions: Sequence[int],
    total_label,
) -> DataFrame:
    """COUNT(DISTINCT value) per (region, area), plus one total row for some regions.

    A distinct count is not additive, so the total has to see the values again; only the rows of
    ``total_regions`` are repeated for it, where GROUPING SETS would repeat every row.
    """
    values = with_totals(df, region, area, total_regions, total_label, [value]).distinct()
    grouped = values.groupBy(region, area).agg(
        F.count_if(~F.col("_total")).alias("_details"),
        F.count_if("_total").alias("_totals"),
        F.count(F.when(~F.col("_total"), F.col(value))).alias("_detail"),
        F.count(F.when(F.col("_total"), F.col(value))).alias("_total_value"),
    )
    return unfold_totals(grouped, region, area, name)


def sums_with_totals(
    df: DataFrame,
    *,
    region: str,
    area: str,
    value: str,
    name: str,
    total_regions: Sequence[int],
    total_label,
) -> DataFrame:
    """SUM(value) per (region, area), plus one total row for some regions.

    Sums are additive: the totals are built from the per-area sums.
    """
    sums = df.groupBy(region, area).agg(F.sum(value).alias(name))
    grouped = (
        with_totals(sums, region, area, total_regions, total_label, [name])
        .groupBy(region, area)
        .agg(
            F.count_if(~F.col("_total")).alias("_details"),
            F.count_if("_total").alias("_totals"),
            F.sum(F.when(~F.col("_total"), F.col(name))).alias("_detail"),
            F.sum(F.when(F.col("_total"), F.col(name))).alias("_total_value"),
        )
    )
    return unfold_totals(grouped, region, area, name)


def most_frequent(
    df: DataFrame, keys: Sequence[str], value: str, *, name: str | None = None
) -> DataFrame:
    """The most frequent non-NULL value(s) of each key; ties are all kept.

    The frequencies are matched with each key's maximum instead of being ranked: a rank needs a
    key's tied values in one task, and a key whose values are all different ties on every one of
    them. The maximum is one row per key, and both sides read the same shuffled frequencies.
    """
    # The group of NULLs counts zero. Filtering it by its count instead of filtering the rows
    # keeps a computed ``value`` from being evaluated a second time in the filter.
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_n")).where("_n > 0")
    top = counts.groupBy(*keys).agg(F.max("_n").alias("_n"))
    return counts.join(top, [*keys, "_n"], "left_semi").select(
        *keys, F.col(value).alias(name or value)
    )
