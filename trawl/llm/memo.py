"""A bounded table from 64-bit keys to runs of ids, looked up for many keys at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Memo:
    """Runs of uint32 ids by key. When it would hold more than ``most`` keys it starts again."""

    def __init__(self, most: int) -> None:
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int32)
        self.counts = np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype=np.uint32)

    def runs(self, keys: np.ndarray, make: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(length of each key's run, all runs one after another).

        ``make(first, keys)`` gives the lengths and the runs of distinct new keys, of which ``first``
        tells where they first occur.
        """
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if new.any():
            if len(self.keys) + int(new.sum()) > self.most:
                self._clear()
                new[:] = True
            self._add(distinct[new], *make(first[new], distinct[new]))
            at = np.searchsorted(self.keys, distinct)
        counts = self.counts[at][inverse].astype(np.int64)
        shift = self.starts[at][inverse] - (np.cumsum(counts) - counts)
        return counts, self.ids[np.repeat(shift, counts) + np.arange(int(counts.sum()))]

    def _add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        starts = (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.counts = np.insert(self.counts, at, counts.astype(np.int32))
