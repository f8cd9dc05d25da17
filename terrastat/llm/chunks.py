"""A worker's table of distinct chunks: each is segmented once, its ids are joined back by position."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable

import numpy as np

from .common import ranges

#: Chunks, and bytes of their names, that a table holds before it is begun anew.
TABLE_ROWS = 400_000
TABLE_BYTES = 16 << 20


class ChunkTable:
    """Ids by chunk name. ``segment`` gives the ids of new chunks, all at once."""

    def __init__(self, segment: Callable[[list], list[list[int]]], limit: int = TABLE_ROWS):
        self.segment, self.limit = segment, limit
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[Hashable, int] = {}
        self.bytes = 0
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.begins, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def begin(self) -> None:
        """Before each batch: a table that has grown over its limit starts again."""
        if len(self.rows) > self.limit or self.bytes > TABLE_BYTES:
            self._clear()

    def find(self, names: list) -> np.ndarray:
        """The table's row of each (distinct) name."""
        if new := [name for name in names if name not in self.rows]:
            # Very many small lists and no cycles: the collector would only walk them again and again.
            collects = gc.isenabled()
            gc.disable()
            found = self.segment(new)
            if collects:
                gc.enable()
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            total = int(lengths.sum())
            if self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.empty(total + len(self.ids), np.int32)])
            self.ids[self.used : self.used + total] = [i for ids in found for i in ids]
            self.begins = np.concatenate([self.begins, self.used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used += total
            self.bytes += sum(len(name if isinstance(name, str) else name[0]) for name in new) + 4 * total
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        return np.fromiter(map(self.rows.__getitem__, names), np.int64, len(names))

    def join(self, position: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has, from the table's rows in order."""
        lengths = self.lengths[position]
        ids = self.ids[ranges(self.begins[position], lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(per_text)
        return ids, upto[ends] - upto[ends - per_text]
