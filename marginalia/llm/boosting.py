"""Gradient-boosted trees with logistic loss, in numpy, for small tabular problems."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on quantile-binned features; at most 256 bins a feature."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8) -> None:
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base = 0.0
        self.trees: list[list[tuple[int, float, float]]] = []  # heap order: (feature, threshold, value); feature < 0 is a leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(max(float(y.mean()), 1e-4), 1 - 1e-4) if len(y) else 0.5
        self.base = float(np.log(p / (1 - p)))
        self.trees = []
        if len(y) < 2 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-f))
            tree, leaf = self._tree(binned, edges, y - prob, prob * (1 - prob))
            f += leaf
            self.trees.append(tree)
        return self

    def _tree(self, b: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray):
        n = 2 ** (self.depth + 1) - 1
        tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * n
        out = np.zeros(len(g))
        rows: dict[int, np.ndarray] = {0: np.arange(len(g))}
        for node in range(n):
            if node not in rows:
                continue
            r = rows.pop(node)
            gs, hs = g[r].sum(), h[r].sum()
            value = self.rate * gs / (hs + 1.0)
            best = (1e-6, -1, 0)
            if node < 2**self.depth - 1 and len(r) >= 2 * self.least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = len(e) + 1
                    gl = np.cumsum(np.bincount(b[r, j], g[r], k))[:-1]
                    hl = np.cumsum(np.bincount(b[r, j], h[r], k))[:-1]
                    nl = np.cumsum(np.bincount(b[r, j], minlength=k))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < self.least) | (len(r) - nl < self.least)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, i)
            if best[1] < 0:
                tree[node] = (-1, 0.0, float(value))
                out[r] = value
            else:
                _, j, i = best
                tree[node] = (j, float(edges[j][i]), float(value))
                left = b[r, j] <= i
                rows[2 * node + 1], rows[2 * node + 2] = r[left], r[~left]
        return tree, out

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class."""
        f = np.full(len(x), self.base)
        for tree in self.trees:
            feature = np.array([t[0] for t in tree])
            threshold = np.array([t[1] for t in tree])
            value = np.array([t[2] for t in tree])
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                j = feature[at]
                inner = j >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(j, 0)] <= threshold[at], 1, 2)
                at = np.where(inner, 2 * at + go, at)
            f += value[at]
        return f
