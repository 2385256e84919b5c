"""Small gradient-boosted trees for a yes or no answer, with calibrated chances. Trained on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Full binary trees of one depth: inner nodes send x to the right if x[feature] > cut."""

    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    start: float
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total

    def chance(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, ridge: float = 1.0
) -> Trees:
    """Newton boosting of the log loss over binned features; ties go to the lower feature, then the lower cut."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    width = bins + 1
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), start)
    inner, outer = 2**depth - 1, 2**depth
    features, places, leaves = [], [], []
    for _ in range(trees):
        p = sigmoid(total)
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            for n in range(first, 2 * first + 1):
                here = np.flatnonzero(node == n)
                if len(here) >= 8:
                    best = _split(binned[here], grad[here], hess[here], width, ridge)
                    if best is not None and best[1] < len(cuts[best[0]]):
                        feature[n], cut[n] = best[0], cuts[best[0]][best[1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, grad, outer) / (np.bincount(at, hess, outer) + ridge)
        total += leaf[at]
        features.append(feature)
        places.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(places), np.array(leaves), start)


def _split(binned, grad, hess, width, ridge):
    n, k = binned.shape
    flat = (binned + np.arange(k) * width).ravel()
    g = np.bincount(flat, np.repeat(grad, k), k * width).reshape(k, width).cumsum(1)
    h = np.bincount(flat, np.repeat(hess, k), k * width).reshape(k, width).cumsum(1)
    gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
    gain[:, -1] = -1
    best = int(gain.argmax())
    return divmod(best, width) if gain.flat[best] > 1e-6 else None


def calibrated(model: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """With the slope and shift that fit rows the trees have not seen (Platt)."""
    z = model.margin(x)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Trees(model.feature, model.cut, model.leaf, model.start, float(max(a, 0.05)), float(b))


def threshold(chance: np.ndarray, y: np.ndarray, precision: float, least: float = 0.5) -> float:
    """The lowest chance from which on at least `precision` of the rows are right; above 1 if there is none."""
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & (chance[order] >= least))
    return float(max(least, chance[order][good[-1]])) if len(good) else 1.1
