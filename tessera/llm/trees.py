"""Gradient-boosted trees with monotonic constraints, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as arrays: node n of tree t asks values[feature] <= threshold; feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probabilities of the positive class for the rows of values, all rows and trees at a time."""
        total = np.full(len(values), self.start)
        rows = np.arange(len(values))
        for t in range(len(self.feature)):
            at = np.zeros(len(values), dtype=np.int32)
            while (inner := self.feature[t, at] >= 0).any():
                goes_left = values[rows, np.maximum(self.feature[t, at], 0)] <= self.threshold[t, at]
                at = np.where(inner, np.where(goes_left, self.left[t, at], self.right[t, at]), at)
            total += self.value[t, at]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(
    values: np.ndarray,
    labels: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least: float = 5.0,
) -> Forest:
    """Boost logistic loss over quantile bins.

    monotone: +1 or -1 for a feature whose score may only rise or fall with it, 0
    for free ones. A split against its sign is not taken, and the halves of a
    taken one are bounded by their midpoint all the way down.
    """
    labels = labels.astype(float)
    rows, columns = values.shape
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(columns)]
    binned = np.stack([np.searchsorted(edges[f], values[:, f], "left") for f in range(columns)], axis=1)
    flat = binned + np.arange(columns) * (bins + 1)
    share = min(max(labels.mean(), 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    size = 2 ** (depth + 1) - 1
    shape = (trees, size)
    feature, threshold = np.full(shape, -1, np.int32), np.zeros(shape)
    left, right, value = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape)
    total = np.full(rows, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = labels - p, np.maximum(p * (1 - p), 1e-9)
        nodes = [(0, np.arange(rows), -np.inf, np.inf, 0)]
        used = 1
        while nodes:
            node, member, low, high, level = nodes.pop()
            g, h = grad[member].sum(), hess[member].sum()
            score = float(np.clip(g / (h + ridge), low, high))
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth:
                width = columns * (bins + 1)
                at = flat[member].ravel()
                hg = np.bincount(at, np.repeat(grad[member], columns), width).reshape(columns, -1).cumsum(1)
                hh = np.bincount(at, np.repeat(hess[member], columns), width).reshape(columns, -1).cumsum(1)
                wl = np.clip(hg / (hh + ridge), low, high)
                wr = np.clip((g - hg) / (h - hh + ridge), low, high)
                gain = wl * hg - wl**2 * (hh + ridge) / 2 + wr * (g - hg) - wr**2 * (h - hh + ridge) / 2
                gain -= score * g - score**2 * (h + ridge) / 2
                wrong = (hh * 4 < least) | ((h - hh) * 4 < least) | (monotone[:, None] * (wr - wl) < 0)
                gain[wrong] = -np.inf
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > best[0] and b < len(edges[f]):
                    best = (gain[f, b], int(f), int(b), wl[f, b], wr[f, b])
            if best[1] < 0:
                value[t, node] = rate * score
                total[member] += rate * score
                continue
            _, f, b, wl, wr = best
            feature[t, node], threshold[t, node] = f, edges[f][b]
            left[t, node], right[t, node] = used, used + 1
            goes = binned[member, f] <= b
            mid = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}
            (ll, lh), (rl, rh) = bounds[int(monotone[f])]
            nodes.append((used, member[goes], ll, lh, level + 1))
            nodes.append((used + 1, member[~goes], rl, rh, level + 1))
            used += 2
    return Forest(feature, threshold, left, right, value, start)
