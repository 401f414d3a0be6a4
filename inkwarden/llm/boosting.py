"""A small gradient-boosted tree classifier for tables of a few thousand rows."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, binned features, trees of fixed depth. Prediction takes an array of rows."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.asarray(x, dtype=float)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        z = np.full(len(y), self.start)
        nodes = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            grad, hess = p - y, p * (1 - p)
            feature, cut, leaf = np.full(nodes, -1), np.zeros(nodes), np.zeros(2**self.depth)
            at = np.zeros(len(y), dtype=int)
            for node in range(nodes):
                here = np.flatnonzero(at == node)
                best = 1e-6
                g, h = grad[here], hess[here]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for f in range(x.shape[1]):
                    if len(edges[f]) == 0 or len(here) == 0:
                        continue
                    gs = np.cumsum(np.bincount(binned[here, f], weights=g, minlength=len(edges[f]) + 1))
                    hs = np.cumsum(np.bincount(binned[here, f], weights=h, minlength=len(edges[f]) + 1))
                    left_g, left_h = gs[:-1], hs[:-1]
                    gain = left_g**2 / (left_h + 1) + (gs[-1] - left_g) ** 2 / (hs[-1] - left_h + 1) - whole
                    gain[(left_h < self.least / 4) | (hs[-1] - left_h < self.least / 4)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, edges[f][k]
                f = feature[node]
                right = x[here, f] > cut[node] if f >= 0 else np.zeros(len(here), dtype=bool)
                at[here] = 2 * node + 1 + right
            for k in range(2**self.depth):
                here = at == nodes + k
                leaf[k] = -grad[here].sum() / (hess[here].sum() + 1) * self.rate
            z += leaf[at - nodes]
            self.model.append((feature, cut, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        x = np.asarray(x, dtype=float)
        z = np.full(len(x), self.start)
        for feature, cut, leaf in self.model:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feature[at]
                right = np.where(f >= 0, x[np.arange(len(x)), np.maximum(f, 0)] > cut[at], False)
                at = 2 * at + 1 + right
            z += leaf[at - len(feature)]
        return z
