"""Gradient boosting of the logistic loss with trees of one depth, on binned features; small, made on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: features and cuts (rounds, 2**depth - 1) by level, leaves (rounds, 2**depth)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    @property
    def depth(self) -> int:
        return self.leaf.shape[1].bit_length() - 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.bias, np.float32)
        rows = np.arange(len(x))
        first = self.leaf.shape[1] - 1
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - first]
        return out


def boost(x: np.ndarray, y: np.ndarray, depth: int = 3, rounds: int = 40, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Trees for the log odds of y; ties between splits go to the first feature and the lowest cut."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    # bins of all features in one row of counts: where a feature's start, and of each bin the feature and the cut above it
    widths = np.array([len(e) + 1 for e in edges])
    starts = np.concatenate(([0], np.cumsum(widths)[:-1]))
    place = np.stack([np.searchsorted(e, x[:, j], side="left") + starts[j] for j, e in enumerate(edges)], axis=1)
    owner, cuts = np.repeat(np.arange(len(edges)), widths), np.concatenate([np.append(e, np.inf) for e in edges])
    base, total = np.repeat(starts, widths), int(widths.sum())

    def left_sums(at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of the weights in and below each bin of its feature."""
        up_to = np.concatenate(([0.0], np.cumsum(np.bincount(at.ravel(), np.repeat(weights, at.shape[1]), total))))
        return up_to[1:] - up_to[base]

    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf, np.float32), np.zeros((rounds, inner + 1), np.float32)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            mine = at == node
            best = (0, np.inf)
            if mine.sum() > 1:
                gl, hl = left_sums(place[mine], g[mine]), left_sums(place[mine], h[mine])
                gs, hs = g[mine].sum(), h[mine].sum()
                gain = np.where(np.isinf(cuts), -np.inf, gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge))
                k = int(gain.argmax())
                if gain[k] > 1e-6:
                    best = (int(owner[k]), float(cuts[k]))
            feature[r, node], cut[r, node] = best
            at[mine] = 2 * node + 1 + (x[mine, best[0]] > np.float32(best[1]))
        at -= inner
        leaf[r] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        margin += leaf[r][at]
    return Trees(feature, cut, leaf, bias)


def platt(margin: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[float, float]:
    """Slope and offset that turn margins into calibrated log odds, fitted to rows the trees haven't seen."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = p * (1 - p)
        ga, gb = ((p - y) * margin).sum() + ridge * (a - 1), (p - y).sum() + ridge * b
        haa, hab, hbb = (w * margin * margin).sum() + ridge, (w * margin).sum(), w.sum() + ridge
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return float(a), float(b)
