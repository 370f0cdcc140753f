"""A small random forest of binary decision trees, in numpy."""

from __future__ import annotations

import numpy as np


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, share of positives); a leaf has feature -1."""
    nodes: list[tuple] = []
    tries = max(1, int(np.sqrt(x.shape[1])) + 1)
    work = [(np.arange(len(y)), 0, -1, 0)]
    while work:
        rows, level, parent, side = work.pop()
        here, share = len(nodes), float(y[rows].mean()) if len(rows) else 0.5
        nodes.append([-1, 0.0, -1, -1, share])
        if parent >= 0:
            nodes[parent][2 + side] = here
        if level == depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
            continue
        best = (0.0, -1, 0.0)
        for f in rng.choice(x.shape[1], tries, replace=False):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            s, t = v[order], y[rows][order]
            ones = np.cumsum(t)[:-1]
            n = np.arange(1, len(rows))
            ok = (s[1:] > s[:-1]) & (n >= leaf) & (len(rows) - n >= leaf)
            if not ok.any():
                continue
            a, b = ones / n, (t.sum() - ones) / (len(rows) - n)
            gain = share * (1 - share) - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
            k = int(np.argmax(np.where(ok, gain, -1)))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((s[k] + s[k + 1]) / 2))
        if best[1] >= 0:
            nodes[here][0], nodes[here][1] = best[1], best[2]
            left = x[rows, best[1]] <= best[2]
            work += [(rows[~left], level + 1, here, 1), (rows[left], level + 1, here, 0)]
    return nodes


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 9, leaf: int = 4, seed: int = 11) -> list[tuple[np.ndarray, ...]]:
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        nodes = _tree(x[rows], y[rows].astype(float), rng, depth, leaf)
        out.append(tuple(np.array([n[k] for n in nodes], float if k in (1, 4) else int) for k in range(5)))
    return out


def predict(forest: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """The mean share of positives over the trees."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, share in forest:
        at = np.zeros(len(x), int)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go = x[rows, np.maximum(f, 0)] <= threshold[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += share[at]
    return total / max(1, len(forest))
