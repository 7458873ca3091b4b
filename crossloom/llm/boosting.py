"""Histogram gradient boosting for two classes, kept as flat arrays; isotonic calibration.

Fitted on a bounded feature matrix; the arrays are a few kilobytes, so a task
gets them with its function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in one set of arrays. A node's children are `left` and `left + 1`; leaves have left = 0."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row: all rows walk down a tree together, `depth` steps each."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                left = self.left[node]
                node = np.where(left > 0, left + (x[rows, self.feature[node]] > self.threshold[node]), node)
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature, at most bins - 1 cut points midway between neighbouring quantile values."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
        edges.append((values[1:] + values[:-1]) / 2)
    return edges


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 4.0) -> Forest:
    """Depth-wise growth on gradient histograms. With one class or no rows, the forest is the smoothed base rate."""
    rate0 = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(rate0 / (1 - rate0)))
    roots, feature, threshold, left, value = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    if len(y) and 0 < y.sum() < len(y):
        edges = bin_edges(x, bins)
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        width = max(len(e) for e in edges) + 1
        flat = codes + np.arange(x.shape[1]) * width
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            root = node()
            roots.append(root)
            open_ = [(root, np.arange(len(y)))]
            for level in range(depth + 1):
                grown = []
                for at, rows in open_:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    value[at] = float(-rate * gs / (hs + l2))
                    margin_rows = rows
                    split = None
                    if level < depth and hs >= 2 * least / 4 and len(rows) >= 2 * least:
                        f = flat[rows].ravel()
                        size = width * x.shape[1]
                        n = np.bincount(f, minlength=size).reshape(-1, width).cumsum(1)[:, :-1]
                        gl = np.bincount(f, np.repeat(g[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)[:, :-1]
                        hl = np.bincount(f, np.repeat(h[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)[:, :-1]
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        gain[(n < least) | (len(rows) - n < least)] = -1
                        best = np.unravel_index(np.argmax(gain), gain.shape)
                        if gain[best] > 1e-6 and best[1] < len(edges[best[0]]):
                            split = best
                    if split is None:
                        margin[margin_rows] += value[at]
                        continue
                    feature[at], threshold[at] = int(split[0]), float(edges[split[0]][split[1]])
                    right = codes[rows, split[0]] > split[1]
                    left[at] = node()
                    node()
                    grown += [(left[at], rows[~right]), (left[at] + 1, rows[right])]
                open_ = grown
    ints = lambda a: np.array(a, np.int32)
    return Forest(base, ints(roots), ints(feature or [0]), np.array(threshold or [0.0]), ints(left or [0]), np.array(value or [0.0]), depth)


@dataclass
class Isotonic:
    """A rising step function through block means, linear between block centres."""

    at: np.ndarray
    level: np.ndarray

    def __call__(self, p: np.ndarray) -> np.ndarray:
        return np.interp(p, self.at, self.level) if len(self.at) else p


def fit_isotonic(p: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators over the scores in ascending order, ties first pooled. No rows: the identity."""
    if not len(p):
        return Isotonic(np.array([]), np.array([]))
    scores, inverse = np.unique(p, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    total = np.bincount(inverse, y)
    blocks: list[list[float]] = []
    for s, w, t in zip(scores, weight, total, strict=True):
        blocks.append([t, w, s * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return Isotonic(b[:, 2] / b[:, 1], b[:, 0] / b[:, 1])
