"""Small gradient-boosted trees on numpy, for models that must travel with a task."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of fixed depth kept as arrays, then a calibrated sigmoid."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale, self.shift = 1.0, 0.0

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]):
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        feature, cut, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(leaves)
        at = np.zeros(len(x), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-9
            if len(rows) > 8:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    for v in c:
                        left = x[rows, f] <= v
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                        if gain > best:
                            best, feature[node], cut[node] = gain, f, v
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        for leaf in range(leaves):
            rows = at == inner + leaf
            value[leaf] = self.rate * g[rows].sum() / (h[rows].sum() + 1)
        return feature, cut, value

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)))[:-1] for f in range(x.shape[1])]
        raw = np.zeros(len(x))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), cuts)
            self.trees.append(tree)
            raw += self._one(tree, x)
        return self

    def _one(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        return value[at - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((self._one(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> BoostedTrees:
        """Platt scaling on rows that were not fitted, by Newton steps with smoothed targets."""
        z = self.raw(x)
        n1 = y.sum()
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(self.scale * z + self.shift)))
            w = p * (1 - p) + 1e-6
            step = np.linalg.solve([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]], [((t - p) * z).sum(), (t - p).sum()])
            self.scale, self.shift = self.scale + step[0], self.shift + step[1]
            if abs(step).max() < 1e-8:
                break
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))
