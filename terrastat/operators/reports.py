"""Sectioned reports: a header row names the area of all the rows below it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.codes import AREA_PREFIX
from .ordering import BUCKET_BITS, forward_fill
from .rejects import FAULTS, cell_fault, row_faults

# Fixed values of the source format.
NOISE_LABELS = ("nan", "total", "edad")
SUMMARY_LABEL = "RESUMEN"
HEADER_START = "AREA"


def drop_noise(df: DataFrame, label: str, noise: Sequence[str] = NOISE_LABELS) -> DataFrame:
    """Drop rows whose case-folded label is in ``noise``; NULL labels go too, as in SQL NOT IN."""
    return df.where(~F.lower(label).isin(*noise))


def sectioned_report(
    df: DataFrame,
    *,
    seq: str,
    label: str,
    value: str,
    keys: Sequence[str] = (),
    summary: str | None = SUMMARY_LABEL,
    bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """Flatten a sectioned report into one row per detail line.

    Result: ``keys``, ``seq``, ``area_code`` and ``area_name`` of the section, the line's
    ``label`` and ``value`` as text. Blank, inner header and total lines are dropped, and so is
    everything from the summary section on.
    """
    rows = drop_noise(df.select(*keys, seq, label, value), label)
    is_header = F.col(label).startswith(HEADER_START)
    marks = {
        "area_code": F.when(is_header, F.replace(F.col(label), F.lit(AREA_PREFIX), F.lit(""))),
        "area_name": F.when(is_header, F.upper(value)),
    }
    if summary is not None:
        # Filled down like the header cells, which costs a flag in the one shuffle where a cut
        # of its own would cost another pass over the rows.
        marks["_past_end"] = F.when(F.col(label) == summary, F.lit(True))
    filled = forward_fill(
        rows.withColumns(marks), list(marks), seq, keys=keys, bucket_bits=bucket_bits
    )
    if summary is not None:
        filled = filled.where(F.col("_past_end").isNull())
    return filled.where(~is_header).select(*keys, seq, "area_code", "area_name", label, value)


def typed_cells(df: DataFrame, *, label: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Cast a flattened report: (region, area) from the 5-digit code, label and value to int.

    ``is_reject`` marks the lines with a part that did not convert; they are kept, so that a
    caller can count or store them. With the columns ``keep`` come the line's own place and, in
    ``faults``, the cells that did not convert, ready for the quarantine.
    """
    code = F.col("area_code")
    parts = {
        "id_prov": F.substring("area_code", 1, 2).try_cast("int"),
        "id_depto": F.substring("area_code", 3, 3).try_cast("int"),
        label: F.col(label).try_cast("int"),
        value: F.col(value).try_cast("int"),
    }
    bad = {name: part.isNull() for name, part in parts.items()}
    columns = [c.alias(n) for n, c in parts.items()]
    if keep:
        found = row_faults(
            cell_fault("area_code", code, bad["id_prov"] | bad["id_depto"], "not an area code"),
            *[cell_fault(c, F.col(c), bad[c], "not a whole number") for c in (label, value)],
        )
        typed = df.select(*keep, *columns, found.alias(FAULTS))
    else:
        typed = df.select(*columns)
    return typed.withColumn("is_reject", F.greatest(*[F.col(n).isNull() for n in parts]))
