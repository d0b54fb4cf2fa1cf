"""Gradient-boosted trees and isotonic calibration for bounded samples, in numpy.

Training data are rows of dense features that fit one machine by a parameter of the
caller; models are plain arrays that can be sent to tasks.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss; complete trees of a depth over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, weight: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.weight = rounds, depth, rate, bins, weight
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T] if len(x) else []
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else x.astype(int)
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            raw += tree[2][leaf]
        return self

    def _grow(self, binned, edges, gradient, curve):
        inner = 2**self.depth - 1
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            local = node - first
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                slot = local * (len(e) + 1) + binned[:, f]
                g = np.bincount(slot, gradient, n * (len(e) + 1)).reshape(n, -1)
                h = np.bincount(slot, curve, n * (len(e) + 1)).reshape(n, -1)
                gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + self.weight) + gr**2 / (hr + self.weight) - gt**2 / (ht + self.weight)
                gain[(hl < 0.5) | (hr < 0.5)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + n][better] = f
                limit[first : first + n][better] = e[at[better]]
            # features go left up to the limit, as in binning
            value = np.array([np.append(e, np.inf) for e in edges], object)
            right = np.array([value[feature[v]][b] > limit[v] for v, b in zip(node, binned[np.arange(len(node)), feature[node]], strict=True)], bool)
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, curve, inner + 1)
        return (feature, limit, -self.rate * g / (h + self.weight)), leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - len(feature)]
        return out


class Isotonic:
    """Monotone calibration of raw scores by pooling adjacent violators, with a weak prior."""

    def __init__(self, raw: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for r, v in zip(raw[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(r), float(r)])
            while len(blocks) > 1 and (blocks[-2][2] == blocks[-1][2] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
                b = blocks.pop()
                a = blocks[-1]
                blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
        mean = float(y.mean()) if len(y) else 0.0
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        self.y = np.maximum.accumulate(np.array([(b[0] + mean) / (b[1] + 1) for b in blocks for _ in (0, 1)])) if blocks else np.zeros(0)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """A share of the raw probability keeps the order within a pooled block."""
        p = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        return p if not len(self.x) else 0.98 * np.interp(raw, self.x, self.y) + 0.02 * p
