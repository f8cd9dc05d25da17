"""Lenient text-to-number conversion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Decimal or exponent notation, or an infinity; Java suffixes such as '1d' and the word 'nan'
# are not numbers.
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def is_number(text: Column) -> Column:
    """TRUE when the cell reads as a number; NULL, blanks and words are FALSE, never NULL."""
    return F.coalesce(text.rlike(_NUMBER), F.lit(False))


def to_whole(text: Column, kind: str) -> Column:
    """The cell as a whole number; ``12.0`` counts as 12, anything else with a fraction is NULL."""
    number = to_number(text)
    whole = F.when(number == F.floor(number), number).try_cast(kind)
    return F.coalesce(F.trim(text).try_cast(kind), whole)


def is_missing(value: Column) -> Column:
    """TRUE for NULL and for NaN, which both mean that there is no value."""
    return value.isNull() | F.isnan(value.cast("double"))


def to_number(text: Column) -> Column:
    """The cell as a double, NULL when it is not a number."""
    return F.when(is_number(text), F.trim(text).try_cast("double"))
