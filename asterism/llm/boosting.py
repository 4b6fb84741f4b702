"""Gradient-boosted trees for two classes, over binned numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Complete binary trees of one depth, as arrays by tree and place; a row goes right where its number is over the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of class 1, for (n, features) rows."""
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (leaf.shape[0] - 1)]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit_boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.2, ridge: float = 1.0, least: float = 4.0) -> Boosted:
    """Newton steps on the logistic loss; splits are looked for between BINS quantiles of each feature.

    A split needs a curvature of ``least`` on both sides and a gain; else all rows of the
    node go left. Of equal splits the first feature's least cut is taken, so refits agree.
    """
    n, d = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = float((weight * y).sum() / weight.sum())
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    cuts = np.full((d, BINS - 1), np.inf)
    binned = np.zeros((n, d), np.int64)
    for f in range(d):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts[f, : len(q)] = q
        binned[:, f] = np.searchsorted(q, x[:, f], side="left")
    score, made = np.full(n, base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            key = (at - first)[:, None] * (d * BINS) + np.arange(d) * BINS + binned
            size = width * d * BINS
            gs, hs = (np.bincount(key.ravel(), np.repeat(v, d), size).reshape(width, d, BINS) for v in (g, h))
            left_g, left_h = gs.cumsum(axis=2)[:, :, :-1], hs.cumsum(axis=2)[:, :, :-1]
            all_g, all_h = gs.sum(axis=2, keepdims=True), hs.sum(axis=2, keepdims=True)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least) | (right_h < least) | np.isinf(cuts)[None]] = 0.0
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            found = flat[np.arange(width), best] > 1e-6
            feature[first : first + width] = np.where(found, best // (BINS - 1), 0)
            cut[first : first + width] = np.where(found, cuts[best // (BINS - 1), best % (BINS - 1)], np.inf)
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        own = at - inner
        leaf = rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + ridge)
        score = score + leaf[own]
        for kind, value in zip(made, (feature, cut, leaf), strict=True):
            kind.append(value)
    return Boosted(*(np.array(m) for m in made), base)
