"""Decoding of location codes whose parts are glued together.

All parts are cut by position from the code's text and converted with ``try_cast``: a bad code
yields NULL parts and is reported by :func:`is_location_reject` or :func:`is_glued_key_reject`
instead of aborting the job.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AREA_PREFIX = "AREA # "


def _digits(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("int")


def _lost_leading_zero(code: Column) -> Column:
    return F.length(code) == 7


def location_province(code: Column) -> Column:
    """Province of an 8-digit location code, or of a 7-digit one that lost its leading zero."""
    return F.when(_lost_leading_zero(code), _digits(code, 1, 1)).otherwise(_digits(code, 1, 2))


def location_department(
    code: Column, district: Column, prefix: str = "COMUNA", factor: int = 7
) -> Column:
    """Department of a location code.

    Districts named ``prefix…`` are numbered by two digits, times ``factor``; every other
    department by the three digits that follow the province.
    """
    return (
        F.when(district.startswith(prefix), _digits(code, 3, 2) * factor)
        .when(_lost_leading_zero(code), _digits(code, 2, 3))
        .otherwise(_digits(code, 3, 3))
    )


def is_location_reject(code: Column) -> Column:
    """TRUE when the code is missing or is not made of 7 or 8 digits."""
    return ~F.coalesce(code.rlike(r"^[0-9]{7,8}$"), F.lit(False))


def is_glued_key_reject(key: Column) -> Column:
    """TRUE when the key is missing or is not made of 4 or 5 digits."""
    return ~F.coalesce(key.rlike(r"^[0-9]{4,5}$"), F.lit(False))


def split_glued_key(key: Column) -> tuple[Column, Column]:
    """(province, department) of a key of 1+3 digits when 4 long, of 2+3 digits otherwise."""
    short = F.length(key) == 4
    province = F.when(short, _digits(key, 1, 1)).otherwise(_digits(key, 1, 2))
    department = F.when(short, _digits(key, 2, 4)).otherwise(_digits(key, 3, 5))
    return province, department
