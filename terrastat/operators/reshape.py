"""Flag columns to a bridge table, and dimensions out of detail rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


_MASK_BITS = 63


def is_set(flag: str) -> Column:
    """A flag cell counts only when its text is exactly ``'1'``."""
    return F.col(flag) == "1"


def unpivot_flags(
    df: DataFrame, key: str, flags: Mapping[str, int], *, type_col: str
) -> DataFrame:
    """Distinct (key, type) pairs, one for each type with a flag column set on any row of the key.

    One scan and one shuffle of a few bigints per key: the types of a row become bits of as many
    masks as are needed (63 types each), masks are OR-ed per key (combined on the map side), and the
    surviving bits are exploded. Flag columns of one type share its bit. The result stays
    partitioned by ``key``, which a following join on the key can use.
    """
    by_type: dict[int, list[str]] = {}
    for flag, type_id in flags.items():
        by_type.setdefault(type_id, []).append(f"`{flag}` = '1'")
    places = {type_id: divmod(i, _MASK_BITS) for i, type_id in enumerate(by_type)}
    masks = range(-(-len(by_type) // _MASK_BITS))
    if not masks:
        raise ValueError("no flag columns")
    bits = [
        " | ".join(
            f"IF({' OR '.join(by_type[t])}, {1 << bit}L, 0L)"
            for t, (mask, bit) in places.items()
            if mask == m
        )
        for m in masks
    ]
    types = ", ".join(
        f"IF(_mask{mask} & {1 << bit}L <> 0, {t}, NULL)" for t, (mask, bit) in places.items()
    )
    return (
        df.groupBy(F.col(f"`{key}`"))
        .agg(*[F.expr(f"bit_or({bits[m]})").alias(f"_mask{m}") for m in masks])
        .where(" OR ".join(f"_mask{m} <> 0" for m in masks))
        .select(
            F.col(f"`{key}`"), F.expr(f"explode(array_compact(array({types})))").alias(type_col)
        )
    )


def extract_dimension(
    df: DataFrame, columns: Sequence[str], extra: DataFrame | None = None
) -> DataFrame:
    """Distinct values of ``columns``, plus the rows of ``extra`` (matched by position).

    The extra slice joins before the one DISTINCT, so both sides share a single shuffle.
    """
    rows = df.select(*columns)
    if extra is not None:
        rows = rows.union(extra)
    return rows.distinct()


def to_long(
    df: DataFrame,
    series: Mapping[str, tuple[str, str]],
    *,
    keep: Sequence[str] = (),
    names: tuple[str, str, str] = ("series", "x", "y"),
) -> DataFrame:
    """One row per series: ``series`` maps a label to its (x column, y column)."""
    label, x, y = names
    points = F.array(
        *[
            F.struct(
                F.lit(name).alias(label),
                F.col(x_col).cast("double").alias(x),
                F.col(y_col).cast("double").alias(y),
            )
            for name, (x_col, y_col) in series.items()
        ]
    )
    return df.select(*keep, F.inline(points))
