"""Gradient-boosted regression trees on binned features, for bounded training tables."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of one depth on the logistic loss; a tree is a heap of (feature, edge) splits."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, least: int = 20):
        self.trees, self.depth, self.rate, self.ridge, self.least = trees, depth, rate, ridge, least
        self.base = 0.0
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            feature, edge = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, n = (1 << level) - 1, 1 << level
                best = np.full(n, 1e-6)
                choice = [(0, np.inf, BINS)] * n
                for k in range(x.shape[1]):
                    if not len(edges[k]):
                        continue
                    key = node * BINS + binned[:, k]
                    g, w, c = (np.cumsum(np.bincount(key, weights=v, minlength=n * BINS).reshape(n, BINS), 1) for v in (gradient, weight, np.ones(len(y))))
                    gain = g**2 / (w + self.ridge) + (g[:, -1:] - g) ** 2 / (w[:, -1:] - w + self.ridge) - g[:, -1:] ** 2 / (w[:, -1:] + self.ridge)
                    gain[(c < self.least) | (c[:, -1:] - c < self.least)] = 0
                    at = gain[:, : len(edges[k])].argmax(1)
                    top = gain[np.arange(n), at]
                    for i in np.flatnonzero(top > best):
                        best[i], choice[i] = top[i], (k, edges[k][at[i]], at[i])
                for i, (k, e, _) in enumerate(choice):
                    feature[first + i], edge[first + i] = k, e
                ks, bins = np.array([c[0] for c in choice]), np.array([c[2] for c in choice])
                node = node * 2 + (binned[np.arange(len(y)), ks[node]] > bins[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, weights=gradient, minlength=leaves) / (np.bincount(node, weights=weight, minlength=leaves) + self.ridge)
            score += value[node]
            self.splits.append((feature, edge, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, edge, value in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
            total += value[node - (len(value) - 1)]
        return total
