"""FM-index over a sequence of small numbers, in numpy: all patterns of a set are searched at once.

Symbol 0 parts the sequence: no pattern holds it, and each 0 counts as a symbol of its own, ordered by place, so that
suffixes end at the next 0 for sorting. The last symbol has to be 0.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only places that still tie are sorted again."""
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    step, tied = 1, None
    while True:
        sorted_rank = rank[order]
        # A rank is the place of the first of its equals, so later rounds never move other groups.
        first = np.ones(n, bool)
        first[1:] = sorted_rank[1:] != sorted_rank[:-1]
        if tied is None:
            starts = np.flatnonzero(first)
            dense = np.repeat(starts, np.diff(np.append(starts, n)))
            rank[order] = dense
            sorted_rank = dense
            first = np.ones(n, bool)
            first[1:] = dense[1:] != dense[:-1]
        last = np.ones(n, bool)
        last[:-1] = first[1:]
        tied = np.flatnonzero(~(first & last))
        if not len(tied):
            return order
        places = order[tied]
        # What ties has no 0 in its first `step` symbols, so place + step is inside the sequence.
        key = rank[places] * (n + 1) + rank[places + step]
        again = np.argsort(key, kind="stable")
        places, key = places[again], key[again]
        order[tied] = places
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        rank[places] = np.repeat(tied[starts], np.diff(np.append(starts, len(key))))
        step *= 2


class FMIndex:
    """Burrows-Wheeler transform in a wavelet matrix, with sampled suffix positions."""

    def __init__(self, text: np.ndarray, sigma: int, sample_every: int = SAMPLE_EVERY):
        order = suffix_order(text)
        n = len(text)
        self.size = n
        before = text[order - 1].astype(np.int64)
        before[order == 0] = 0
        counts = np.bincount(text, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # rows whose suffix begins with a smaller symbol
        # Positions are kept at every k-th place and behind each 0, where the walk back would have to stop.
        self.sampled = (order % sample_every == 0) | (before == 0)
        self.rank_of_sample = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.before = before
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        now = before
        for level in range(self.levels):
            bit = (now >> (self.levels - 1 - level)) & 1
            ones = np.zeros(n + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before row `at` of the transform."""
        begin, end = np.zeros_like(at), at.copy()
        for level in range(self.levels):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            b, e = ones[begin], ones[end]
            begin = np.where(one, zeros + b, begin - b)
            end = np.where(one, zeros + e, end - e)
        return end - begin

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of right-aligned patterns: which occur, and their first and last + 1 rows."""
        alive = np.flatnonzero(lengths > 0)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1] if len(patterns) else 0
        done = []
        for step in range(width):
            ended = lengths[alive] == step
            done.append(alive[ended])
            alive = alive[~ended]
            if not len(alive):
                break
            symbol = patterns[alive, width - 1 - step].astype(np.int64)
            base = self.first[symbol]
            low[alive] = base + self.rank(symbol, low[alive])
            high[alive] = base + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        found = np.concatenate([*done, alive]) if done else alive
        return found, low[found], high[found]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffix rows: walk back to the next sample."""
        out = np.zeros(len(rows), np.int64)
        todo, now, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.sampled[now]
            out[todo[hit]] = self.samples[self.rank_of_sample[now[hit]]] + steps
            todo, now = todo[~hit], now[~hit]
            symbol = self.before[now]
            now = self.first[symbol] + self.rank(symbol, now)
            steps += 1
        return out
