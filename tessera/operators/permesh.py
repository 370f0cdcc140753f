"""Inherently sequential operators, one mesh to a task: helpers to hand a mesh to numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.model import Mesh


def per_mesh(mesh: Mesh, run: Callable[[int, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """run(mesh_id, positions [V, 3], triangles [T, 3] of rows of positions, vertex ids) for every mesh."""

    def task(key, v: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        v, t = v.sort_values("vid"), t.sort_values("tid")
        ids = v["vid"].to_numpy()
        tri = np.searchsorted(ids, t[["i0", "i1", "i2"]].to_numpy()) if len(t) else np.zeros((0, 3), int)
        out = run(int(key[0]), v[["x", "y", "z"]].to_numpy(float), tri, ids)
        return out

    triangles = mesh.triangles.selectExpr("mesh_id AS of_mesh", "tid", "i0", "i1", "i2")  # a name of its own: both sides may stem from one table
    return mesh.vertices.groupBy("mesh_id").cogroup(triangles.groupBy("of_mesh")).applyInPandas(task, schema)


def weld(p: np.ndarray, tolerance: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(remap, first vertex of each cell), cells numbered by first appearance."""
    diag = float(np.linalg.norm(p.max(0) - p.min(0))) if len(p) else 0.0
    cell = tolerance if tolerance > 0 else max(1e-9, 1e-6 * diag)
    k = np.nan_to_num(np.sign(p) * np.floor(np.abs(p) / cell + 0.5), nan=0, posinf=0, neginf=0)
    _, first, inverse = np.unique(k, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    return rank[inverse.reshape(-1)], first[order]


def cross(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.cross(p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]) if len(t) else np.zeros((0, 3))


def unit(v: np.ndarray, fallback=(0.0, 0.0, 1.0)) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.where(n > 1e-12, v / np.where(n > 1e-12, n, 1), fallback)


def edge_pairs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge [E, 2] low first, triangle, half-edge) of all half-edges, sorted by edge."""
    e = np.concatenate((t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]])) if len(t) else np.zeros((0, 2), int)
    f = np.tile(np.arange(len(t)), 3)
    e = np.sort(e, 1)
    order = np.lexsort((f, e[:, 1], e[:, 0]))
    return e[order], f[order], order


def neighbour_pairs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triangle, triangle, edge [., 2]) of each pair of half-edges on one edge, by edge."""
    e, f, _ = edge_pairs(t)
    at, found, step = np.arange(len(e)), [], 1
    while len(at):
        at = at[at + step < len(e)]
        at = at[(e[at] == e[at + step]).all(1)]
        found.append(np.stack((at, at + step), 1))
        step += 1
    both = np.concatenate(found) if found else np.zeros((0, 2), int)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return f[both[:, 0]], f[both[:, 1]], e[both[:, 0]]


def neighbours(t: np.ndarray) -> list[tuple[int, int, tuple[int, int]]]:
    """neighbour_pairs() as a list."""
    a, b, e = neighbour_pairs(t)
    return list(zip(a.tolist(), b.tolist(), map(tuple, e.tolist())))


class Sets:
    """Disjoint sets, each named by its least member."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, a: int) -> int:
        while self.of[a] != a:
            self.of[a] = self.of[self.of[a]]
            a = self.of[a]
        return a

    def join(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)
        return min(a, b)


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the least that it reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        far = x != y
        if not far.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[far], np.minimum(x, y)[far])
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
