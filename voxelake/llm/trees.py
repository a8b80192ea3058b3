"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes one after another; a leaf has feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                node = np.where(f < 0, node, np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node]))
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 20) -> Forest:
    """monotone[f]: +1 the score may only rise with feature f, -1 only fall, 0 free."""
    n, k = x.shape
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(k)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(k)], 1) if n else np.zeros((0, k), int)
    width = bins + 1
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, bias)

    def add() -> int:
        for column, v in ((feature, -1), (threshold, 0.0), (value, 0.0)):
            column.append(v)
        left.append(len(feature) - 1)
        right.append(len(feature) - 1)
        return len(feature) - 1

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(add())
        level = [(roots[-1], np.arange(n), -np.inf, np.inf)]
        for d in range(depth + 1):
            following = []
            for node, rows, low, high in level:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                value[node] = float(rate * np.clip(total_g / (total_h + l2), low, high))
                if d == depth or len(rows) < 2 * least:
                    continue
                best = (1e-6, -1, 0, 0.0, 0.0)
                for f in range(k):
                    if not len(cuts[f]):
                        continue
                    c = code[rows, f]
                    gs = np.cumsum(np.bincount(c, g[rows], width))[:-1]
                    hs = np.cumsum(np.bincount(c, h[rows], width))[:-1]
                    ns = np.cumsum(np.bincount(c, minlength=width))[:-1]
                    vl = np.clip(gs / (hs + l2), low, high)
                    vr = np.clip((total_g - gs) / (total_h - hs + l2), low, high)
                    gain = gs * vl - (hs + l2) * vl**2 / 2 + (total_g - gs) * vr - (total_h - hs + l2) * vr**2 / 2
                    gain -= total_g**2 / (total_h + l2) / 2
                    ok = (ns >= least) & (len(rows) - ns >= least)
                    if monotone[f]:
                        ok &= (vr - vl) * monotone[f] >= 0
                    gain = np.where(ok, gain, -np.inf)[: len(cuts[f])]
                    at = int(np.argmax(gain))
                    if gain[at] > best[0]:
                        best = (float(gain[at]), f, at, float(vl[at]), float(vr[at]))
                _, f, at, vl, vr = best
                if f < 0:
                    continue
                feature[node], threshold[node] = f, float(cuts[f][at])
                left[node], right[node] = add(), add()
                middle = (vl + vr) / 2
                bound = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
                goes = code[rows, f] <= at
                following += [(left[node], rows[goes], *bound[0]), (right[node], rows[~goes], *bound[1])]
            level = following
        tree = Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots[-1:]), depth, 0.0)
        margin += tree.margin(x)
    return Forest(np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(right, int), np.array(value, float), np.array(roots, int), depth, bias)
