"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees in five arrays; a leaf points at itself, so that scoring is ``depth`` steps for every row."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _best(g, h, low, high, sign, l2, least):
    """The best split of one node on one feature from the sums per bin: gain, bin, values of both sides."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
    whole = np.clip(-g.sum() / (h.sum() + l2), low, high)
    loss = lambda gs, hs, v: gs * v + (hs + l2) * v * v / 2
    gain = loss(g.sum(), h.sum(), whole) - loss(gl, hl, vl) - loss(gr, hr, vr)
    gain[(hl < least) | (hr < least) | (sign * (vr - vl) < 0)] = -1
    k = int(gain.argmax()) if len(gain) else 0
    return (gain[k], k, vl[k], vr[k]) if len(gain) else (-1.0, 0, 0.0, 0.0)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic loss over histograms. ``monotone``: 1 or -1 where the score may only rise or fall with a feature, else 0.

    A constrained split must order its sides' values, and their middle bounds everything below either side; so the sum
    of all trees is monotone.
    """
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add(value: float) -> int:
        i = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", value)):
            nodes[k].append(v)
        return i

    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(len(monotone))]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if len(x) else np.zeros((0, len(monotone)), int)
    total = np.full(len(y), start)
    for _ in range(trees if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        roots.append(add(0.0))
        growing = [(roots[-1], np.arange(len(y)), -np.inf, np.inf)]
        for level in range(depth + 1):
            below = []
            for node, rows, low, high in growing:
                nodes["value"][node] = float(rate * np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
                if level == depth:
                    total[rows] += nodes["value"][node]
                    continue
                found = []
                for j, e in enumerate(edges):
                    b = binned[rows, j]
                    found.append((*_best(np.bincount(b, g[rows], len(e) + 1), np.bincount(b, h[rows], len(e) + 1), low, high, monotone[j], l2, least), j))
                gain, k, vl, vr, j = max(found, key=lambda f: f[0])
                if gain <= 1e-6:
                    total[rows] += nodes["value"][node]
                    continue
                left, right, middle = add(0.0), add(0.0), (vl + vr) / 2
                nodes["feature"][node], nodes["threshold"][node], nodes["left"][node], nodes["right"][node] = j, float(edges[j][k]), left, right
                go = binned[rows, j] <= k
                s = monotone[j]
                below.append((left, rows[go], middle if s < 0 else low, middle if s > 0 else high))
                below.append((right, rows[~go], middle if s > 0 else low, middle if s < 0 else high))
            growing = below
    kinds = {"feature": int, "threshold": float, "left": int, "right": int, "value": float}
    return Forest(*[np.array(v, kinds[k]) for k, v in nodes.items()], np.array(roots, int), depth, start)
