"""Columns of 64-bit keys, packed for a shuffle: a row holds all of a task's keys for one bucket.

Buckets are ranges of the (hashed) key, so they are equally full and a sorted array is cut, not
sorted again. Keys are stored as differences, byte plane by byte plane, which compresses well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(sorted_keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, where its keys are) of each bucket that has any."""
    if not len(sorted_keys):
        return
    of = bucket_of(sorted_keys, buckets)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        yield int(of[a]), slice(a, b)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, in ascending order where that makes them small."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def pack_places(places: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, byte plane by byte plane: the upper ones are mostly zero."""
    return places.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_places(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def pack_repeated(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits of which many repeat: the distinct ones, and for each which one it is."""
    distinct, number = np.unique(values, return_inverse=True)
    return len(distinct).to_bytes(4, "little") + pack(distinct) + pack_places(number)


def unpack_repeated(data: bytes) -> np.ndarray:
    upto = 4 + 8 * int.from_bytes(data[:4], "little")
    return unpack(data[4:upto])[unpack_places(data[upto:])]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.empty(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(begins) else counts[:0]
