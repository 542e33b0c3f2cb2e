"""Small gradient-boosted trees for tabular candidates: logistic loss, binned features, numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Trees:
    """Boosted trees; `fit` on a bounded sample, `predict` calibrated probabilities."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    ridge: float = 1.0
    least: int = 4
    base: float = 0.0
    trees: list = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = sigmoid(margin)
            tree: list[list] = []
            self._grow(tree, x, code, edges, prob - y, prob * (1 - prob) + 1e-9, np.arange(len(y)), self.depth, margin)
            self.trees.append(tree)
        return self

    def _grow(self, tree, x, code, edges, g, h, rows, depth, margin) -> int:
        at = len(tree)
        tree.append([-1, 0.0, 0, 0, 0.0])
        value = -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, edge in enumerate(edges):
                n = len(edge) + 1
                if n < 2:
                    continue
                c = code[rows, f]
                lg, lh = np.bincount(c, g[rows], n).cumsum()[:-1], np.bincount(c, h[rows], n).cumsum()[:-1]
                count = np.bincount(c, minlength=n).cumsum()[:-1]
                gain = lg**2 / (lh + self.ridge) + (total_g - lg) ** 2 / (total_h - lh + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(count < self.least) | (len(rows) - count < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            tree[at][4] = value
            margin[rows] += value
            return at
        _, f, k = best
        left = code[rows, f] <= k
        tree[at][:2] = [f, float(edges[f][k])]
        tree[at][2] = self._grow(tree, x, code, edges, g, h, rows[left], depth - 1, margin)
        tree[at][3] = self._grow(tree, x, code, edges, g, h, rows[~left], depth - 1, margin)
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            for i, row in enumerate(x):
                at = 0
                while tree[at][0] >= 0:
                    at = tree[at][2] if row[tree[at][0]] <= tree[at][1] else tree[at][3]
                out[i] += tree[at][4]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows that the trees were not fitted on."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = sigmoid(a * m + b)
            a, b = a - 0.1 * (((p - y) * m).mean() + 1e-2 * (a - 1)), b - 0.1 * ((p - y).mean() + 1e-2 * b)
        self.scale = (max(float(a), 1e-3), float(b))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.margin(x) + self.scale[1])

    def threshold(self, x: np.ndarray, y: np.ndarray, precision: float) -> float:
        """The least score from which on the given precision is kept on held-out rows; 0.5 at least."""
        p = self.predict(x)
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= precision)
        return max(0.5, float(p[order[good[-1]]])) if len(good) else 0.999
