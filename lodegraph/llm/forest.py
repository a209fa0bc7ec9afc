"""A random forest of binary decision trees, in numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    def __init__(self, trees: int = 32, depth: int = 8, leaf: int = 4, seed: int = 5):
        self.n, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        g = np.random.default_rng(self.seed)
        for _ in range(self.n):
            pick = g.integers(len(y), size=len(y))
            self.trees.append(self._grow(x[pick], y[pick].astype(float), g))
        return self

    def _grow(self, x, y, g):
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows, depth):
            k = len(feature)
            for col, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, float(y[rows].mean()))):
                col.append(v)
            if depth < self.depth and len(rows) >= 2 * self.leaf and 0 < value[k] < 1:
                best = self._split(x[rows], y[rows], g)
                if best:
                    f, c = best
                    low = x[rows, f] <= c
                    feature[k], cut[k] = f, c
                    left[k], right[k] = node(rows[low], depth + 1), node(rows[~low], depth + 1)
            return k

        node(np.arange(len(y)), 0)
        return tuple(np.array(c) for c in (feature, cut, left, right, value))

    def _split(self, x, y, g):
        """(feature, threshold) with the least Gini impurity among a root of the features, drawn anew."""
        best, found = np.inf, None
        for f in g.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False).tolist():
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v) + 1)
            ok = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= self.leaf) & (n[-1] - n[:-1] >= self.leaf))
            if not len(ok):
                continue
            nl, nr, ol, orr = n[ok], n[-1] - n[ok], ones[ok], ones[-1] - ones[ok]
            gini = ol * (1 - ol / nl) + orr * (1 - orr / nr)
            k = int(gini.argmin())
            if gini[k] < best:
                best, found = gini[k], (f, float((v[ok[k]] + v[ok[k] + 1]) / 2))
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives in the leaves that each row reaches."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]))
            total += value[at]
        return total / max(1, len(self.trees))
