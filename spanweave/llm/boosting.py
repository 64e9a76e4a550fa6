"""Gradient-boosted trees for small binary problems, in NumPy.

Logistic loss, second-order leaf values, depth-limited trees with quantile split points. Trees
are plain arrays, so a fitted model travels to the workers in a task's closure.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """An ensemble; ``feature`` is -1 at leaves, ``value`` holds thresholds or leaf values."""

    base: float
    depth: int
    feature: np.ndarray
    value: np.ndarray
    threshold: float = 0.5
    names: list[str] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, v in zip(self.feature, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[node] >= 0
                right = x[rows, np.maximum(f[node], 0)] > v[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            score += v[node]
        return 1.0 / (1.0 + np.exp(-score))


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5, l2: float = 1.0) -> Boosted:
    """Fit on features ``x`` (rows x columns) and labels ``y`` (0 or 1)."""
    n, m = x.shape
    mean = float(np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    size = 2 ** (depth + 1) - 1
    feature, value = np.full((rounds, size), -1), np.zeros((rounds, size))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)))[:-1] if n else np.zeros(0) for j in range(m)]
    below = [[x[:, j] <= c for c in cuts[j]] for j in range(m)]
    score = np.full(n, base)
    for t in range(rounds):
        p = 1.0 / (1.0 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        members = {0: np.ones(n, bool)}
        for node in range(size):
            at = members.get(node)
            if at is None:
                continue
            G, H = g[at].sum(), h[at].sum()
            best, where = 1e-6, None
            if node < size // 2:
                for j in range(m):
                    for k, mask in enumerate(below[j]):
                        left = at & mask
                        c = int(left.sum())
                        if c < least or at.sum() - c < least:
                            continue
                        gl, hl = g[left].sum(), h[left].sum()
                        gain = gl * gl / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G * G / (H + l2)
                        if gain > best:
                            best, where = gain, (j, k, left)
            if where is None:
                value[t, node] = -rate * G / (H + l2)
                score[at] += value[t, node]
            else:
                j, k, left = where
                feature[t, node], value[t, node] = j, cuts[j][k]
                members[2 * node + 1], members[2 * node + 2] = left, at & ~left
        if np.abs(g).max(initial=0) < 0.01:
            feature, value = feature[: t + 1], value[: t + 1]
            break
    return Boosted(base, depth, feature, value)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on held-out rows; the middle of the best range."""
    if not len(y) or y.min() == y.max():
        return 0.5
    grid = np.linspace(0.1, 0.9, 33)
    f1 = np.array([2 * (y[p > t].sum()) / max((p > t).sum() + y.sum(), 1) for t in grid])
    best = grid[f1 >= f1.max() - 1e-9]
    return float(best[len(best) // 2])
