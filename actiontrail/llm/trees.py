"""Gradient-boosted trees for a yes/no target: fitted on a bounded sample, flattened to node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf points to itself, so scoring is a fixed number of gathers."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 1.0,
        least: int = 5, monotone: dict[int, int] | None = None) -> Forest:
    """`monotone`: feature number -> 1 (the score never falls as it grows) or -1 (never rises)."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    width = bins
    codes = np.stack([np.searchsorted(edges[f], x[:, f], "left") + f * width for f in range(m)], 1)
    bounds = np.full((m, width), np.inf)
    for f in range(m):
        bounds[f, :len(edges[f])] = edges[f]
    sign = np.zeros(m)
    for f, s in (monotone or {}).items():
        sign[f] = s
    rate_of_yes = min(max(float(np.mean(y)), 1e-3), 1 - 1e-3)
    start = float(np.log(rate_of_yes / (1 - rate_of_yes)))
    margin = np.full(n, start)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        todo = [(len(nodes) - 1, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            g, h = grad[rows], curve[rows]
            best = float(np.clip(-g.sum() / (h.sum() + l2), low, high))
            split = None
            if level < depth and len(rows) >= 2 * least:
                flat = codes[rows].ravel()
                hist_g = np.bincount(flat, np.repeat(g, m), m * width).reshape(m, width).cumsum(1)
                hist_h = np.bincount(flat, np.repeat(h, m), m * width).reshape(m, width).cumsum(1)
                many = np.bincount(flat, minlength=m * width).reshape(m, width).cumsum(1)
                gl, hl, gr, hr = hist_g, hist_h, hist_g[:, -1:] - hist_g, hist_h[:, -1:] - hist_h
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                # Loss at the values that the bounds allow, second order.
                loss = lambda g, h, v: g * v + 0.5 * (h + l2) * v * v
                gain = loss(g.sum(), h.sum(), best) - loss(gl, hl, vl) - loss(gr, hr, vr)
                bad = (many < least) | (len(rows) - many < least) | (sign[:, None] * (vr - vl) < 0) | ~np.isfinite(bounds)
                gain = np.where(bad, -np.inf, gain)
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, b] > 1e-6:
                    split = f, b, float(vl[f, b]), float(vr[f, b])
            if split is None:
                nodes[at][4] = best * rate
                margin[rows] += best * rate
                continue
            f, b, a, c = split
            goes = codes[rows, f] - f * width <= b
            kids = len(nodes), len(nodes) + 1
            nodes[at][:4] = [f, bounds[f, b], *kids]
            nodes += [[0, np.inf, k, k, 0.0] for k in kids]
            middle = (a + c) / 2
            ends = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(sign[f]), ((low, high),) * 2)
            todo += [(kids[0], rows[goes], level + 1, *ends[0]), (kids[1], rows[~goes], level + 1, *ends[1])]
    table = np.asarray(nodes, float)
    return Forest(np.asarray(roots), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int),
                  table[:, 4], start, depth)
