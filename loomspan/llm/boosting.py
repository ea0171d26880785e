"""Gradient-boosted regression trees for two classes, on histograms; small and deterministic."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting. Features are cut into at most ``bins`` quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 24, least: float = 2.0, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, prob - y, prob * (1 - prob))
            self.trees.append(tree)
            score += self._walk(binned, tree)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int64) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, at, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(b), np.int64)
        width = self.bins + 1
        for k in range(2**self.depth - 1 + 2**self.depth):
            rows = np.nonzero(node == k)[0]
            if not len(rows):
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value[k] = -self.rate * total_g / (total_h + self.ridge)
            if k >= 2**self.depth - 1 or total_h < 2 * self.least:
                continue
            flat = (b[rows] + np.arange(b.shape[1]) * width).ravel()
            left_g = np.bincount(flat, np.repeat(g[rows], b.shape[1]), b.shape[1] * width).reshape(-1, width).cumsum(axis=1)
            left_h = np.bincount(flat, np.repeat(h[rows], b.shape[1]), b.shape[1] * width).reshape(-1, width).cumsum(axis=1)
            gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
            gain[(left_h < self.least) | (total_h - left_h < self.least)] = 0
            best = int(gain.argmax())
            if gain.ravel()[best] > 1e-6:
                feature[k], at[k] = divmod(best, width)
                node[rows] = np.where(b[rows, feature[k]] <= at[k], 2 * k + 1, 2 * k + 2)
        return feature, at, value

    def _walk(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, at, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            go = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > at[node]
            node = np.where(go, 2 * node + 1 + right, node)
        return value[node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self._walk(binned, tree)
        return out
