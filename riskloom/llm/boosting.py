"""Gradient-boosted trees on histograms, kept as flat arrays.

Training bins each column at quantiles and grows trees level by level from histograms of gradients. A tree
is a complete binary tree in arrays: node i has the children 2 i + 1 and 2 i + 2, a node that was not split
sends all rows left. Scoring walks all rows of a batch down one level at a time. Training takes a bounded
sample; scoring is for tasks on Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``column``, ``limit`` (inner nodes) and ``value`` (all nodes), each trees x nodes; and the base score."""

    column: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row of ``x``; NaN goes left."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1] + 1)) - 1 if len(self.value) else 0
        for column, limit, value in zip(self.column, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, column[at]] > limit[at])
            out += value[at]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -700, 700)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    ridge: float = 1.0,
    least: float = 1.0,
    prior: float | None = None,
) -> Trees:
    """Boost logistic loss on rows ``x`` with classes ``y``.

    ``least`` is the smallest sum of second derivatives on each side of a split. ``prior`` is the share of
    class 1 outside a balanced sample; rows are weighted to it. With one class only there are no trees.
    """
    n, n_cols = x.shape if x.ndim == 2 else (0, 0)
    share = (y.sum() + 0.5) / (n + 1.0)
    prior = share if prior is None else min(max(prior, 1e-6), 1 - 1e-6)
    base = float(np.log(prior / (1 - prior)))
    empty = np.zeros((0, 2 ** (depth + 1) - 1))
    if not 0 < y.sum() < n:
        return Trees(empty.astype(np.int64), empty, empty, base)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    edges = [np.unique(np.nanquantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(n_cols)]
    binned = np.stack([np.searchsorted(edges[c], x[:, c], "left") for c in range(n_cols)])  # value <= edge: left
    binned[np.isnan(x.T)] = 0
    score = np.full(n, base)
    inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
    columns, limits, values = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-score))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-12)
        column, limit, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            here = at - first
            best = np.full(width, 1e-9)
            cut = np.full(width, -1)
            for c in range(n_cols):
                k = len(edges[c]) + 1
                if k < 2:
                    continue
                cell = here * k + binned[c]
                gs = np.bincount(cell, g, minlength=width * k).reshape(width, k).cumsum(axis=1)
                hs = np.bincount(cell, h, minlength=width * k).reshape(width, k).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0.0
                top = gain.argmax(axis=1)
                won = gain[np.arange(width), top] > best
                best = np.where(won, gain[np.arange(width), top], best)
                column[first : first + width][won] = c
                cut[won] = top[won]
            split = cut >= 0
            for node in np.flatnonzero(split):
                limit[first + node] = edges[column[first + node]][cut[node]]
            right = split[here] & (binned[column[at], np.arange(n)] > cut[here])
            at = 2 * at + 1 + right
        leaf = at - inner
        g_sum, h_sum = (np.bincount(leaf, v, minlength=inner + 1) for v in (g, h))
        value[inner:] = -rate * g_sum / (h_sum + ridge)
        score += value[at]
        columns.append(column)
        limits.append(limit)
        values.append(value)
    return Trees(np.array(columns), np.array(limits), np.array(values), base)
