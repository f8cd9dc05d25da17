"""One-row data-quality metrics, each a single pass of partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import is_number


def _percent(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole)) * 100


def numeric_quality(df: DataFrame, column: str) -> DataFrame:
    """Rows, rows whose cell is not a number (NULL included), and their percentage."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~is_number(F.col(column))).alias("non_numeric_rows"),
    ).withColumn("pct_non_numeric", _percent("non_numeric_rows", "total_rows"))


def contact_quality(df: DataFrame, mail: str) -> DataFrame:
    """Share of rows with several addresses, and of invalid ones (a space, or no ``@``).

    The classes overlap. Missing addresses are in neither, but are part of the total.
    """
    m = F.col(mail)
    ats = F.length(m) - F.length(F.replace(m, F.lit("@"), F.lit("")))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(ats > 1).alias("multiple"),
        F.count_if(m.contains(" ") | ~m.contains("@")).alias("invalid"),
    ).withColumns(
        {
            "pct_multiple": _percent("multiple", "total_rows"),
            "pct_invalid": _percent("invalid", "total_rows"),
        }
    )


def flag_quality(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Cells in the flag columns that are not exactly ``'1'``; NULL is not ``'1'``."""
    unset = [(~F.col(f).eqNullSafe("1")).cast("bigint") for f in flags]
    return df.agg(
        (F.count(F.lit(1)) * len(flags)).alias("total_cells"),
        F.coalesce(F.sum(sum(unset[1:], unset[0])), F.lit(0)).alias("unset_cells"),
    ).withColumn("pct_unset", _percent("unset_cells", "total_cells"))
