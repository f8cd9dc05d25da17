"""Text expressions for hand-typed contact fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# The Unicode space separators (category Zs).
_SPACES = (
    "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)


def trim_unicode(text: Column) -> Column:
    """Strip every Unicode space separator (U+00A0 included, tabs not) from both ends.

    Spark's ``trim`` alone only knows U+0020.
    """
    return F.btrim(text, F.lit(_SPACES))


def first_email(mail: Column) -> Column:
    """First address of a field that may hold several, or NULL when it has no ``@``.

    The field is cut at its first comma if it has one, at its first space otherwise; only the
    text before the cut is looked at, so a valid address after ``'s/d '`` is not found.
    """
    separator = F.when(mail.contains(","), F.lit(",")).otherwise(F.lit(" "))
    head = F.split_part(trim_unicode(mail), separator, F.lit(1))
    return F.when(head.contains("@"), F.translate(head, " ,", ""))


def email_domain(mail: Column, drop_empty: bool = False) -> Column:
    """Case-folded text after the first ``@``; ``''`` when nothing follows it.

    ``drop_empty=True`` turns that ``''`` into NULL.
    """
    domain = F.lower(F.split_part(trim_unicode(mail), F.lit("@"), F.lit(2)))
    return F.nullif(domain, F.lit("")) if drop_empty else domain
