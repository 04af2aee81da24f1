"""Small histogram gradient boosting for logistic loss, in NumPy on the driver.

Meant for bounded training samples; what it returns is a few kilobytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes in one array; a leaf has feature -1. ``x <= cut`` goes left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(16):
            f = self.feature[at]
            if (f < 0).all():
                break
            goes = x[np.arange(len(x)), np.maximum(f, 0)] <= self.cut[at]
            at = np.where(f < 0, at, np.where(goes, self.left[at], self.right[at]))
        return self.value[at]

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conjunction that leads to each node but the root: (feature, is_upper, cut)."""
        found, todo = [], [(0, ())]
        while todo:
            at, path = todo.pop()
            if path:
                found.append(path)
            if self.feature[at] >= 0:
                f, c = int(self.feature[at]), float(self.cut[at])
                todo += [(int(self.left[at]), (*path, (f, False, c))), (int(self.right[at]), (*path, (f, True, c)))]
        return found


def _bins(x: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, most + 1)[1:-1], method="lower")) for col in x.T]
    return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1), cuts


def _grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: float, ridge: float, most: int) -> Tree:
    """One tree; ``binned`` holds the bins of feature f shifted by f * most, so one count covers all features."""
    nodes: list[list] = []
    features = binned.shape[1]
    usable = np.arange(most)[None, :] < np.array([len(c) for c in cuts])[:, None]

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + ridge)

    def sums(bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(bins, np.repeat(weights, features), features * most).reshape(features, most).cumsum(axis=1)

    def add(rows: np.ndarray, left_depth: int) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, -1, -1, -g / (h + ridge)])
        if left_depth and h > 2 * least:
            bins = binned[rows].ravel()
            gl, hl = sums(bins, grad[rows]), sums(bins, hess[rows])
            gain = np.where(usable & (hl >= least) & (h - hl >= least), score(gl, hl) + score(g - gl, h - hl) - score(g, h), 0)
            f, k = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, k] > 1e-6:
                goes = binned[rows, f] <= f * most + k
                nodes[me][:2] = [int(f), float(cuts[f][k])]
                nodes[me][2] = add(rows[goes], left_depth - 1)
                nodes[me][3] = add(rows[~goes], left_depth - 1)
        return me

    add(np.arange(len(grad)), depth)
    cols = list(zip(*nodes))
    return Tree(np.array(cols[0]), np.array(cols[1], float), np.array(cols[2]), np.array(cols[3]), np.array(cols[4], float))


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 2.0, ridge: float = 1.0) -> Boosted:
    """Boosting for 0/1 labels; one class only gives its (smoothed) share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(share / (1 - share))), rate, [])
    if not 0 < y.sum() < len(y):
        return model
    binned, cuts = _bins(x, bins)
    binned = binned + np.arange(x.shape[1]) * (bins + 1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, cuts, p - y, p * (1 - p), depth, least, ridge, bins + 1)
        model.trees.append(tree)
        margin += rate * tree.predict(x)
    return model
