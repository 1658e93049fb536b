"""Gradient-boosted trees for two classes, by histograms of binned features.

Trees are complete: a node that finds no useful split sends all rows left. So a
tree is three arrays and a row's path is a sequence of array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """feature and threshold by tree and inner node (children of k: 2k+1, 2k+2), value by tree and leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 of each row."""
        total = np.full(len(x), self.start, dtype=np.float32)
        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (flat[base + feature[node]] > threshold[node])
            total += value[node - inner]
        return total

    def save(self, path: str) -> None:
        np.savez_compressed(path, feature=self.feature, threshold=self.threshold, value=self.value, start=self.start)

    @staticmethod
    def load(path: str) -> Trees:
        with np.load(path) as found:
            return Trees(found["feature"], found["threshold"], found["value"], float(found["start"]))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.2, ridge: float = 2.0, least: float = 4.0, weight: np.ndarray | None = None) -> Trees:
    """Trees fitted one after another to the gradient of the logistic loss by Newton's step.

    ``least`` is the curvature that a child needs at least, ``ridge`` shrinks leaves.
    """
    rows, width = x.shape
    w = np.ones(rows) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)]).astype(np.int64)
    share = float(np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6))
    score = np.full(rows, np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((trees, inner), np.int16), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves), np.float32), float(score[0]) if rows else 0.0)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = w * (y - p), w * p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                at = (node - first) * BINS + binned[f]
                g = np.bincount(at, slope, many * BINS).reshape(many, BINS)
                h = np.bincount(at, curve, many * BINS).reshape(many, BINS)
                gl, hl = np.cumsum(g, 1)[:, : len(cuts[f])], np.cumsum(h, 1)[:, : len(cuts[f])]
                ga, ha = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = -1
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best
                best[better] = gain[np.arange(many), top][better]
                out.feature[t, first : first + many][better] = f
                out.threshold[t, first : first + many][better] = cuts[f][top[better]]
            node = 2 * node + 1 + (x[np.arange(rows), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        out.value[t] = rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + ridge)
        score = score + out.value[t][leaf]
    return out
