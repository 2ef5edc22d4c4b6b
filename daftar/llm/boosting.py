"""Gradient-boosted trees for a yes-or-no label, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    edges: tuple[np.ndarray, ...]  # of the bins, per feature
    features: np.ndarray  # rounds x inner nodes
    splits: np.ndarray
    leaves: np.ndarray  # rounds x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.edges)
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, split, leaf in zip(self.features, self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while node.max(initial=0) < len(feature):
                node = 2 * node + 1 + (bins[row, feature[node]] > split[node])
            out += leaf[node - len(feature)]
        return out


def _binned(x: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), dtype=np.int64)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Trees of full depth grown level by level on the second-order gain of the logistic loss."""
    edges = tuple(np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS)[1:-1])) for i in range(x.shape[1]))
    bins = _binned(x, edges)
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_of / (1 - rate_of)))
    margin, inner = np.full(len(y), start), 2**depth - 1
    features, splits, leaves = (np.zeros((rounds, n), dtype=t) for n, t in ((inner, np.int64), (inner, np.int64), (inner + 1, float)))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(node == at)
                best, features[r, at], splits[r, at] = 1e-9, 0, BINS
                for f in range(x.shape[1]) if len(mine) else ():
                    sums = [np.cumsum(np.bincount(bins[mine, f], w[mine], BINS)) for w in (g, h)]
                    (gl, hl), (gt, ht) = [s[:-1] for s in sums], [s[-1] for s in sums]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    if gain.max() > best:
                        best, features[r, at], splits[r, at] = gain.max(), f, int(gain.argmax())
            node = 2 * node + 1 + (bins[np.arange(len(y)), features[r][node]] > splits[r][node])
        leaf = node - inner
        leaves[r] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += leaves[r][leaf]
    return Trees(edges, features, splits, leaves, start)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, fitted by Newton's method on held-out rows."""
    # targets drawn a little towards the middle, so that separable rows give finite values
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w, design = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (p - t))
        w = w - np.clip(step, -1, 1)
    return float(w[0]), float(w[1])
