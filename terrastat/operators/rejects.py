"""Quarantine: the cells that did not decode, beside the rows that did.

A decoder adds one array column with a fault for each bad cell: its column, its text as it was read
and the reason. The decoded table, its reject table and the reject counts are then three selections
from the same decoded rows; nothing is decoded a second time, and no row is lost from sight: what a
model table leaves out has its faults in the quarantine.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

FAULTS = "faults"
#: Type of the column of faults.
FAULT_TYPE = "array<struct<column:string,raw:string,reason:string>>"

MISSING = "missing"


def cell_fault(column: str, raw: Column, bad: Column, reason: str, *, required: bool = True) -> Column:
    """The fault of one cell: NULL where it is good, ``missing`` where a required one is NULL.

    ``bad`` need not be FALSE for a NULL cell.
    """
    def told(why: str) -> Column:
        return F.struct(
            F.lit(column).alias("column"), raw.cast("string").alias("raw"), F.lit(why).alias("reason")
        )

    if required:
        return F.when(raw.isNull(), told(MISSING)).when(bad, told(reason))
    return F.when(raw.isNotNull() & bad, told(reason))


def row_faults(*cells: Column) -> Column:
    """The faults of a row, in the order of ``cells``; an empty array where all are good."""
    return F.array_compact(F.array(*cells)).cast(FAULT_TYPE)


def has_fault(column: str, faults: str = FAULTS) -> Column:
    """TRUE where the row has a fault in ``column``."""
    return F.exists(faults, lambda f: f["column"] == column)


def is_faulty(faults: str = FAULTS) -> Column:
    return F.size(faults) > 0


def quarantine(
    decoded: DataFrame, source: str, *, path: str, position: str, faults: str = FAULTS
) -> DataFrame:
    """(source, path, position, column, raw, reason), one row for each fault of the decoded rows."""
    return decoded.select(
        F.lit(source).alias("source"),
        F.col(path).alias("path"),
        F.col(position).cast("bigint").alias("position"),
        F.inline(faults),
    )


def reject_table(
    decoded: Mapping[str, DataFrame], places: Mapping[str, tuple[str, str]], faults: str = FAULTS
) -> DataFrame:
    """The quarantine of several sources; ``places`` names each one's path and position columns."""
    tables = [
        quarantine(df, source, path=places[source][0], position=places[source][1], faults=faults)
        for source, df in decoded.items()
    ]
    return reduce(DataFrame.unionAll, tables)


def reject_counts(decoded: Mapping[str, DataFrame], faults: str = FAULTS) -> DataFrame:
    """(source, total, rejected, faults): rows, rows with a fault, and faults of each source.

    A source without rows has a row of zeros. ``faults`` is the number of its rows in the quarantine.
    """
    counts = [
        df.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(is_faulty(faults)).alias("rejected"),
            F.coalesce(F.sum(F.size(faults)), F.lit(0)).cast("bigint").alias("faults"),
        ).select(F.lit(source).alias("source"), "total", "rejected", "faults")
        for source, df in decoded.items()
    ]
    return reduce(DataFrame.unionAll, counts)
