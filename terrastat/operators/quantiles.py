"""Exact quantiles per group by range order.

The points are counted per (group, value) and the counts dealt out by ranges of that pair, once.
A part then holds whole groups, except the first and the last one in it, which may go on in its
neighbours. Quantiles of whole groups are read off the running counts where they stand. Of the
others, two a part at most, the driver adds up the parts' totals, and each quantile's place is
looked up in the one part that holds it. No task sees more than its part, whatever the size of a group, and
the counts are not shuffled again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numbers import is_missing
from ..sources.literal import literal_table
from ..sources.shared import stage
from .ranges import PART, shuffle_parts

_COUNTED = (
    "_key string, _v double, _n bigint, _part int, _before bigint, points bigint, _found array<double>, _open_n bigint"
)


def frequencies(points: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, _n): how often each value occurs in its group; NULL and NaN are no points."""
    return (
        points.where(~is_missing(F.col(value)))
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def dealt_counts(counted: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """:func:`frequencies` dealt by range and written, with all that :func:`read_quantiles` needs.

    The result has the group under its own name and the value, as a double, as ``_v``.
    """
    # Grouped by its text, so that NULL and NaN are groups like others.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = counted.select(
        key.alias("_key"), F.col(value).cast("double").alias("_v"), "_n", F.col(group).alias("_group")
    )
    dealt = (
        rows.repartitionByRange(shuffle_parts(counted), "_key", "_v")
        .sortWithinPartitions("_key", "_v")
        .withColumn(PART, F.spark_partition_id())
    )

    schema = T.StructType([*T.StructType.fromDDL(_COUNTED), rows.schema["_group"]])

    # Local functions, so that workers need not find this package.
    def counted_part(part: pa.Table) -> pa.RecordBatch:
        """The part with running counts of each group.

        The first row of a whole group has its points and quantiles, that of another its count here.
        """
        rows = part.num_rows
        key = part.column("_key").combine_chunks()
        value, n = part.column("_v").to_numpy(), part.column("_n").to_numpy()
        changes = pc.not_equal(key.slice(1), key.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], changes]))
        ends = np.append(starts[1:], rows)
        upto = np.cumsum(n)
        base = upto[starts] - n[starts]
        total = upto[ends - 1] - base
        whole = np.ones(len(starts), bool)
        whole[[0, -1]] = False
        place = np.array(shares) * (total[:, None] - 1)
        low, high = np.floor(place), np.ceil(place)
        low_value, high_value = (
            value[np.minimum(np.searchsorted(upto, base[:, None] + rank, "right"), rows - 1)] for rank in (low, high)
        )
        found = low_value + (high_value - low_value) * (place - low)
        first, edge = np.zeros(rows, bool), np.zeros(rows, bool)
        first[starts[whole]], edge[starts[~whole]] = True, True
        points = np.zeros(rows, np.int64)
        points[starts] = total
        lists = np.empty(rows, object)
        lists[starts[whole]] = [found[i].tolist() for i in np.flatnonzero(whole)]
        before = upto - n - np.repeat(base, ends - starts)
        columns = [
            *[part.column(c).combine_chunks() for c in ("_key", "_v", "_n", PART)],
            pa.array(before),
            pa.array(points, mask=~first),
            pa.array(lists, pa.list_(pa.float64())),
            pa.array(points, mask=~edge),
            part.column("_group").combine_chunks(),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if filled := [b for b in batches if b.num_rows]:
            yield counted_part(pa.Table.from_batches(filled))

    return stage(dealt.mapInArrow(run, schema)).withColumnRenamed("_group", group)


def _ranks(points: int, shares: list[float]) -> list[int]:
    places = [share * (points - 1) for share in shares]
    return sorted({rank(place) for place in places for rank in (math.floor, math.ceil)})


def _of_open_groups(dealt: DataFrame, group: str, shares: list[float]) -> list[tuple]:
    """(group, points, quantiles) of the first and the last group of each part.

    The driver gets two rows a part at most, and two values for each quantile of these groups.
    """
    counts: dict[str, list[tuple[int, int]]] = {}
    names = {}
    for r in dealt.where(F.col("_open_n").isNotNull()).select(PART, "_key", "_open_n", group).collect():
        counts.setdefault(r._key, []).append((r[PART], r._open_n))
        names[r._key] = r[group]
    total = {key: sum(n for _, n in parts) for key, parts in counts.items()}
    targets = []
    for key, parts in counts.items():
        earlier = 0
        for part, n in sorted(parts):
            targets += [(part, key, rank - earlier, rank) for rank in _ranks(total[key], shares) if earlier <= rank < earlier + n]
            earlier += n
    wanted = literal_table(
        dealt.sparkSession, targets, T.StructType.fromDDL("_at int, _of string, _left bigint, _rank bigint")
    )
    at = (
        (F.col(PART) == F.col("_at"))
        & (F.col("_key") == F.col("_of"))
        & (F.col("_before") <= F.col("_left"))
        & (F.col("_left") < F.col("_before") + F.col("_n"))
    )
    found = dealt.join(F.broadcast(wanted), at).select("_of", "_rank", "_v").collect()
    value = {(r._of, r._rank): r._v for r in found}
    out = []
    for key, points in total.items():
        quantiles = []
        for share in shares:
            place = share * (points - 1)
            low, high = value[key, math.floor(place)], value[key, math.ceil(place)]
            quantiles.append(low + (high - low) * (place - math.floor(place)))
        out.append((names[key], points, *quantiles))
    return out


def read_quantiles(dealt: DataFrame, group: str, quantiles: Mapping[str, float]) -> DataFrame:
    """(group, points, each quantile) from :func:`dealt_counts` made with the same shares."""
    whole = dealt.where(F.col("points").isNotNull()).select(
        group, "points", *[F.col("_found")[i].alias(name) for i, name in enumerate(quantiles)]
    )
    shares = [float(q) for q in quantiles.values()]
    rest = literal_table(dealt.sparkSession, _of_open_groups(dealt, group, shares), whole.schema)
    return whole.unionAll(rest)


def group_quantiles(
    points: DataFrame, *, group: str, value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` (as a double) per group; NULL and NaN are no points.

    A row for each group with points: the group, ``points`` (how many) and each quantile by its
    name. The counts are written to the shared folder (:func:`terrastat.sources.stage`).
    """
    counted = frequencies(points, group, value)
    return read_quantiles(dealt_counts(counted, group, value, list(quantiles.values())), group, quantiles)
