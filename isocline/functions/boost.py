"""Gradient-boosted trees on bounded training tables: logistic loss, histograms, leaves grown where they gain most.

A fit is one task's work; many organisms, folds or seeds are fitted side by side by grouped functions.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class BoostedTrees:
    def __init__(self, trees: int = 150, leaves: int = 8, rate: float = 0.05, bins: int = 64, least: int = 20, ridge: float = 1.0):
        self.trees, self.leaves, self.rate, self.bins, self.least, self.ridge = trees, leaves, rate, bins, least, ridge

    def _coded(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def _best(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        """Gain, feature and last left bin of a leaf's best cut."""
        best = (0.0, -1, -1)
        whole = g.sum() ** 2 / (h.sum() + self.ridge)
        for j, edges in enumerate(self.edges):
            n = len(edges) + 1
            sums = [np.cumsum(np.bincount(codes[:, j], w, n))[:-1] for w in (g, h, None)]
            if not len(sums[0]):
                continue
            gl, hl, count = sums
            gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - whole
            gain[(count < self.least) | (len(g) - count < self.least)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Classes weigh alike whatever their numbers."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = y.mean()
        weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes, score = self._coded(x), np.zeros(len(y))
        self.forest: list[tuple[list[tuple[int, int, int, int]], list[float]]] = []
        for _ in range(self.trees):
            p = _sigmoid(score)
            g, h = weight * (p - y), weight * p * (1 - p)
            # A node is (feature, bin, left, right); a leaf is (-1, 0, place of its value, 0).
            nodes = [(-1, 0, 0, 0)]
            rows = {0: np.arange(len(y))}
            cuts = {0: self._best(codes, g, h)}
            while len(rows) < self.leaves:
                at = max(cuts, key=lambda n: cuts[n][0])
                gain, j, k = cuts[at]
                if j < 0 or gain <= 1e-12:
                    break
                left = codes[rows[at], j] <= k
                nodes[at] = (j, k, len(nodes), len(nodes) + 1)
                for part in (rows[at][left], rows[at][~left]):
                    rows[len(nodes)], cuts[len(nodes)] = part, self._best(codes[part], g[part], h[part])
                    nodes.append((-1, 0, 0, 0))
                del rows[at], cuts[at]
            values: list[float] = []
            for n, part in rows.items():
                nodes[n] = (-1, 0, len(values), 0)
                values.append(float(-self.rate * g[part].sum() / (h[part].sum() + self.ridge)))
                score[part] += values[-1]
            self.forest.append((nodes, values))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        codes = self._coded(np.asarray(x, float))
        score = np.zeros(len(codes))
        for nodes, values in self.forest:
            todo = [(0, np.arange(len(codes)))]
            while todo:
                n, rows = todo.pop()
                j, k, left, right = nodes[n]
                if j < 0:
                    score[rows] += values[left]
                elif len(rows):
                    low = codes[rows, j] <= k
                    todo += [(left, rows[low]), (right, rows[~low])]
        return _sigmoid(score)
