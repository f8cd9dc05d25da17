"""Operators that depend on row order, without a task that sees all rows.

Every operator takes ``seq``, a bigint column that gives each row's position. It must be unique
within one document (``keys`` identify the document; with no keys the table is one document). A
NULL in either fails the job: such a row has no place, and an equi-join would lose it silently.

A window over the whole document would put it in one task. Instead positions are cut into
buckets of ``2**bucket_bits`` consecutive values, so a bucket never holds more rows than that,
whatever the data: one hot document is simply more buckets. Each bucket is worked on locally, and
what has to cross bucket borders is computed from one summary row per bucket. The summary is cut
the same way into groups of ``2**group_bits`` buckets, so neither does its size matter: dense
positions up to 10^12 give 15 million summary rows in 15 groups.

The join that brings the border values back is on the columns the rows are already partitioned
by, so the wide rows are shuffled exactly once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .ranges import total_before

_BUCKET, _GROUP = "_bucket", "_group"

_MAX_SEQ = 2**63 - 1

BUCKET_BITS = 16
GROUP_BITS = 20


class _Plain:
    """``df`` with plain names (c0, c1, ...), so that dots and spaces need no care inside."""

    def __init__(self, df: DataFrame, seq: str, keys: Sequence[str]):
        self.names = list(df.columns)
        self.of = {name: f"c{i}" for i, name in enumerate(self.names)}
        self.seq, self.keys = self.of[seq], [self.of[k] for k in keys]
        # A filter that the planner derives for a join evaluates the check as well.
        error = F.raise_error(F.lit("no position or no document: sequence and keys must not be NULL"))
        placed = {c: F.coalesce(F.col(c), error) for c in [self.seq, *self.keys]}
        self.df = df.toDF(*self.of.values()).withColumns(placed)

    def back(self, columns: Mapping[str, Column] | None = None) -> list[Column]:
        """All columns under their own names, some of them replaced."""
        columns = columns or {}
        return [columns.get(c, F.col(c)).alias(n) for n, c in self.of.items()]


def _with_bucket(plain: _Plain, bits: int) -> DataFrame:
    # The coalesce tells the planner that buckets are never NULL. Without it each join below adds
    # its own IS NOT NULL to one of the summaries, which then no longer share one shuffle.
    position = F.coalesce(F.col(plain.seq).cast("bigint"), F.lit(0))
    return plain.df.withColumn(_BUCKET, F.shiftright(position, bits))


def _group_of(bits: int) -> Column:
    return F.shiftright(F.col(_BUCKET), bits)


def _before(*order: str, within: Sequence[str] = ()) -> WindowSpec:
    """Frame of all rows strictly before the current one."""
    window = Window.partitionBy(*within) if within else Window
    return window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _whole(*order: str, within: Sequence[str]) -> WindowSpec:
    """Frame of all rows of the partition."""
    return (
        Window.partitionBy(*within)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )


def _first_of_group(keys: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys, _GROUP).orderBy(_BUCKET)) == 1


def _document_starts(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _document_start) from (keys, _documents_n): rows of all documents that come before."""
    return total_before(documents, keys, "_documents_n", "_document_start").drop("_documents_n")


def dense_row_id(
    df: DataFrame,
    seq: str,
    *,
    keys: Sequence[str] = (),
    id_col: str = "row_id",
    bucket_bits: int = BUCKET_BITS,
    group_bits: int = GROUP_BITS,
) -> DataFrame:
    """Number the rows 1..n in (keys, seq) order; the id is the first column of the result.

    Without keys the one window without a partition runs over a row for each group of buckets. With
    keys, of any types and as many as needed, documents may be as many as rows: the list of them is
    dealt out by range and written, and their starts are running totals over its parts.
    """
    plain = _Plain(df, seq, keys)
    keys = plain.keys
    rows = _with_bucket(plain, bucket_bits)

    counts = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(_GROUP, _group_of(group_bits))
    )
    group = [*keys, _GROUP]
    # Both uses of the summary keep its columns as they are, so that they share one shuffle.
    first_of_group = (
        counts.withColumns(
            {
                "_group_n": F.sum("_n").over(_whole(_BUCKET, within=group)),
                "_first": _first_of_group(keys),
            }
        )
        .where("_first")
        .select(*group, F.sum("_group_n").over(_before(_GROUP, within=keys)).alias("_group_start"))
    )
    starts = (
        counts.withColumn("_bucket_start", F.sum("_n").over(_before(_BUCKET, within=group)))
        .join(first_of_group, group)
        .select(
            *keys,
            _BUCKET,
            (
                F.coalesce("_group_start", F.lit(0)) + F.coalesce("_bucket_start", F.lit(0))
            ).alias("_start"),
        )
    )
    if keys:
        documents = counts.groupBy(*keys).agg(F.sum("_n").alias("_documents_n"))
        starts = starts.join(_document_starts(documents, keys), keys).select(
            *keys, _BUCKET, (F.col("_start") + F.col("_document_start")).alias("_start")
        )

    numbered = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys, _BUCKET).orderBy(plain.seq))
    )
    return numbered.join(starts, [*keys, _BUCKET]).select(
        (F.col("_start") + F.col("_rank")).cast("bigint").alias(id_col), *plain.back()
    )


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    seq: str,
    *,
    keys: Sequence[str] = (),
    bucket_bits: int = BUCKET_BITS,
    group_bits: int = GROUP_BITS,
) -> DataFrame:
    """Replace NULLs in ``columns`` by the last value above them in the same document.

    Rows above the first value keep NULL. Each column is filled on its own.
    """
    plain = _Plain(df, seq, keys)
    seq, keys, columns = plain.seq, plain.keys, [plain.of[c] for c in columns]
    rows = _with_bucket(plain, bucket_bits)

    # Only rows that carry a value (usually few: section headers) reach the max_by, which has to
    # sort its input when the values are strings.
    last_values = (
        rows.where(reduce(or_, [F.col(c).isNotNull() for c in columns]))
        .groupBy(*keys, _BUCKET)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])
    )
    marks = (
        rows.select(*keys, _BUCKET)
        .distinct()
        .join(last_values, [*keys, _BUCKET], "left")
        .withColumn(_GROUP, _group_of(group_bits))
    )
    group = [*keys, _GROUP]
    whole_group = _whole(_BUCKET, within=group)
    before_group = _before(_GROUP, within=keys)
    from_groups = (
        marks.withColumns(
            {f"_last_{c}": F.last(c, ignorenulls=True).over(whole_group) for c in columns}
            | {"_first": _first_of_group(keys)}
        )
        .where("_first")
        .select(
            *group,
            *[
                F.last(f"_last_{c}", ignorenulls=True).over(before_group).alias(f"_group_{c}")
                for c in columns
            ],
        )
    )
    before_bucket = _before(_BUCKET, within=group)
    above = (
        marks.withColumns(
            {f"_near_{c}": F.last(c, ignorenulls=True).over(before_bucket) for c in columns}
        )
        .join(from_groups, group)
        .select(
            *keys,
            _BUCKET,
            *[F.coalesce(f"_near_{c}", f"_group_{c}").alias(f"_above_{c}") for c in columns],
        )
    )

    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    return filled.join(above, [*keys, _BUCKET]).select(
        *plain.back({c: F.coalesce(c, f"_above_{c}") for c in columns})
    )


def truncate_at_sentinel(
    df: DataFrame,
    is_sentinel: Column,
    seq: str,
    *,
    keys: Sequence[str] = (),
    bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """Keep the rows above the first sentinel row; all of them where there is none.

    For the table as one document the position of the cut is a scalar subquery and the rows are
    only filtered. With ``keys`` the cut of each document is a grouped minimum, and each of its
    buckets is told it: a join of the rows by document alone would bring all of a large one to one
    task.
    """
    marked = df.withColumn("_is_sentinel", is_sentinel)
    plain = _Plain(marked, seq, keys)
    sentinel, seq, keys = F.col(plain.of.pop("_is_sentinel")), plain.seq, plain.keys
    if not keys:
        first = plain.df.where(sentinel).agg(F.min(seq)).scalar()
        kept = plain.df.where(F.col(seq) <= F.coalesce(first - 1, F.lit(_MAX_SEQ)))
        return kept.select(*plain.back())
    rows = _with_bucket(plain, bucket_bits)
    cuts = rows.where(sentinel).groupBy(*keys).agg(F.min(seq).alias("_cut"))
    told = rows.select(*keys, _BUCKET).distinct().join(cuts, keys, "left")
    return (
        rows.join(told, [*keys, _BUCKET])
        .where(F.col("_cut").isNull() | (F.col(seq) < F.col("_cut")))
        .select(*plain.back())
    )
