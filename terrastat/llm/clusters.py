"""Centroid clustering by the threshold algorithm.

Each dimension has a list of the centroids sorted by their component there. For a vector the lists
are walked outward from its own value, nearest component first; a centroid met for the first time
gets its exact distance. No centroid that is still unmet is nearer than the sum of the squared gaps
at the frontiers, so the walk stops once that sum strictly exceeds the best exact distance: all
centroids at the least distance have been met by then, and ties go to the smaller number.

Vectors are whole numbers, ``floor(scale * x)``, so distances, sums and means are exact and the
result depends on no order. A vector is kept if it has exactly ``dimensions`` components, none of
them NULL, NaN or infinite, and each below 2^27 once scaled, in either direction: squared distances
would not fit a long beyond that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import col, stage

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
#: Cells of an array that a walk holds at once; vectors are worked on in slices of that.
WALK_CELLS = 1 << 18
_MOST = 1 << 27
_FAR = np.iinfo(np.int64).max


def whole_vectors(lists: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the kept vectors among ``lists``, and their components as whole numbers."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(lists), dimensions), False)
    places = np.flatnonzero(fit.to_numpy(zero_copy_only=False))
    parts = lists.filter(fit).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.floor(parts.reshape(len(places), dimensions) * float(scale))
    kept = (np.abs(scaled) < _MOST).all(axis=1)  # not so for NaN, which a NULL has become
    return places[kept], scaled[kept].astype(np.int64)


def _walk(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, k = len(vectors), len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, axis=0)
    dimension = np.arange(vectors.shape[1])
    above = np.stack([np.searchsorted(lists[:, j], vectors[:, j]) for j in dimension], axis=1)
    below = above - 1
    met = np.zeros((n, k), bool)
    nearest, best = np.full(n, k, np.int64), np.full(n, _FAR, np.int64)
    active = np.arange(n)
    while len(active):
        own, up, down = vectors[active], above[active], below[active]
        gap_up = np.where(up < k, lists[np.minimum(up, k - 1), dimension] - own, _FAR)
        gap_down = np.where(down >= 0, own - lists[np.maximum(down, 0), dimension], _FAR)
        upward = gap_up < gap_down
        taken = np.where(upward, up, down)
        frontier = np.where(upward, gap_up, gap_down)
        above[active] = up + upward
        below[active] = down - ~upward
        here = np.zeros((len(active), k), bool)
        np.put_along_axis(here, order[taken, dimension], True, axis=1)
        here &= ~met[active]
        met[active] |= here
        for c in np.flatnonzero(here.any(axis=0)):
            who = active[here[:, c]]
            distance = np.square(vectors[who] - centroids[c]).sum(axis=1)
            closer = (distance < best[who]) | ((distance == best[who]) & (c < nearest[who]))
            best[who[closer]], nearest[who[closer]] = distance[closer], c
        # A list of k centroids is at its end after k steps, and by then all have been met.
        active = active[(np.square(frontier).sum(axis=1) <= best[active]) & ~met[active].all(axis=1)]
    return nearest, best


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid."""
    step = max(1, WALK_CELLS // (vectors.shape[1] + len(centroids)))
    found = [_walk(vectors[i : i + step], centroids) for i in range(0, len(vectors), step)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found))


def _columns(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(col(id_col).alias("vec_id"), col(vector_col).alias("vector"))


def first_centroids(df: DataFrame, id_col: str, vector_col: str, *, k: int, dimensions: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` kept vectors with the smallest sha256 of ``seed:id``, in that order; ties by component.

    Only ``k`` rows of each task, and in the end of all, are held in one place.
    """
    rows = _columns(df, id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, vectors = whole_vectors(batch.column("vector"), dimensions, scale)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), dimensions).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(places)), lists], ["vec_id", "vector"])

    kept = rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, vector array<bigint>")
    name = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), "vector").limit(k).select("vector").collect()
    return np.array([r.vector for r in first], np.int64).reshape(len(first), dimensions)


def next_centroids(df: DataFrame, id_col: str, vector_col: str, centroids: np.ndarray, *, scale: int) -> np.ndarray:
    """Each centroid replaced by the floored mean of the vectors nearest to it; empty ones stay.

    A task adds up its own vectors and sends one row for each centroid; the driver gets one number
    for each centroid and dimension.
    """
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            _, vectors = whole_vectors(batch.column("vector"), dimensions, scale)
            nearest, _ = nearest_centroids(vectors, centroids)
            by_cluster = np.argsort(nearest, kind="stable")
            count = np.bincount(nearest, minlength=k)
            filled = np.flatnonzero(count)
            if len(filled):
                sums[filled, :-1] += np.add.reduceat(vectors[by_cluster], (np.cumsum(count) - count)[filled], axis=0)
                sums[:, -1] += count
        used = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used), "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})

    sums = (
        _columns(df, id_col, vector_col)
        .select("vector")
        .mapInArrow(run, "cluster bigint, sums array<bigint>")
        .select("cluster", F.posexplode("sums").alias("place", "value"))
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("total"))
        .collect()
    )
    total = {(r.cluster, r.place): int(r.total) for r in sums}
    out = centroids.copy()
    for c in {c for c, _ in total}:
        out[c] = [total[c, j] // total[c, dimensions] for j in range(dimensions)]
    return out


def assign(df: DataFrame, id_col: str, vector_col: str, centroids: np.ndarray, *, scale: int) -> DataFrame:
    """(vec_id, cluster int, distance bigint) of each kept vector; no shuffle."""
    rows = _columns(df, id_col, vector_col)
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, vectors = whole_vectors(batch.column("vector"), dimensions, scale)
            nearest, distance = nearest_centroids(vectors, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(places)), pa.array(nearest.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"],
            )

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def centroid_clusters(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector.

    Centroids begin as ``k`` vectors chosen by hash and are replaced by floored means in each round;
    afterwards the vectors are assigned once more. With fewer kept vectors than ``k`` there are as
    many centroids; with none the result is empty. Repeated rows count each on its own; a NULL
    identifier is kept and hashed as the empty text. Vectors that are not kept (see the module) have
    no row; other columns are ignored. The table is read once a round and shuffled never. Broadcast
    are ``k`` centroids and their totals, which do not grow with the table.
    """
    options = {"scale": scale}
    centroids = first_centroids(df, id_col, vector_col, k=k, dimensions=dimensions, seed=seed, **options)
    if len(centroids):
        for _ in range(rounds):
            centroids = next_centroids(df, id_col, vector_col, centroids, **options)
    else:
        df = df.limit(0)
    assigned = stage(assign(df, id_col, vector_col, centroids, **options), "clusters")
    inertia = {
        r.cluster: int(r.inertia)
        for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()
    }
    spark = df.sparkSession
    totals = spark.createDataFrame(
        [(c, n, sum(inertia.values()), centroid_digest(centroids[c])) for c, n in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
