"""The first row from a position on whose time lies in a range, for many askers at once.

Rows of a block stand in order of position. A table of levels is laid over them: level k holds the ranks of times of every aligned run of 2**k
rows, sorted. Whether a run holds a time of the range is one search in its level; an asker climbs over runs without one and
goes down into the first that has one, so an answer takes a logarithm of the block's rows, whatever lies between.
"""

from __future__ import annotations

import numpy as np


class FirstInRange:
    def __init__(self, times: np.ndarray):
        """`times` in order of position."""
        self.sorted = np.sort(times)
        ranks = np.searchsorted(self.sorted, times)
        self.many, self.width = len(times), len(times) + 1
        self.levels = []
        for k in range(max(1, int(self.many - 1).bit_length() + 1)):
            self.levels.append(np.sort((np.arange(self.many) >> k) * self.width + ranks))

    def _has(self, level: np.ndarray, run: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether runs of a level hold a rank in [low, high)."""
        return np.searchsorted(level, run * self.width + high) > np.searchsorted(level, run * self.width + low)

    def ask(self, begin: np.ndarray, first_time: np.ndarray, last_time: np.ndarray) -> np.ndarray:
        """For each asker the first place from `begin` on with a time in [first_time, last_time], or the number of rows."""
        low, high = np.searchsorted(self.sorted, first_time), np.searchsorted(self.sorted, last_time, "right")
        at, found = begin.astype(np.int64).copy(), np.full(len(begin), -1, np.int64)
        # Up: odd runs are passed over one by one, each level twice as wide.
        todo = np.flatnonzero((at < self.many) & (low < high))
        for k, level in enumerate(self.levels):
            odd = todo[(at[todo] >> k) & 1 == 1] if k + 1 < len(self.levels) else todo
            hit = self._has(level, at[odd] >> k, low[odd], high[odd])
            found[odd[hit]] = k
            at[odd[~hit]] += 1 << k
            todo = todo[(found[todo] < 0) & (at[todo] < self.many)]
        at[found < 0] = self.many
        # Down: into the left half if it holds one.
        for k in range(len(self.levels) - 1, 0, -1):
            here = np.flatnonzero(found == k)
            left = self._has(self.levels[k - 1], at[here] >> (k - 1), low[here], high[here])
            at[here[~left]] += 1 << (k - 1)
            found[here] = k - 1
        return at
