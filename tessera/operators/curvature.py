"""Per-vertex principal curvatures, slippage of regions and crease rings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.model import Mesh, halfedges
from tessera.operators.foundations import face_normals
from tessera.operators.permesh import cross, per_mesh, unit


def _frames(n: np.ndarray, hint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = np.cross(hint, n)
    bad = np.linalg.norm(u, axis=1) <= 1e-12
    helper = np.where(np.abs(n[:, :1]) < 0.9, [[1.0, 0.0, 0.0]], [[0.0, 1.0, 0.0]])
    u = np.where(bad[:, None], np.cross(helper, n), u)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    return u, np.cross(n, u)


def _turned(u: np.ndarray, v: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames (u, v) turned so that their normals become ``to``."""
    n = np.cross(u, v)
    c = (n * to).sum(1, keepdims=True)
    flip = c <= -1 + 1e-6
    axis = to - c * n
    half = (n + to) / np.where(flip, 1, 1 + c)
    out = [np.where(flip, -x, x - half * (x * axis).sum(1, keepdims=True)) for x in (u, v)]
    return out[0], out[1]


def vertex_curvatures(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """[V, 8]: k1, k2 (k1 of the larger magnitude) and their directions; zeros where there is no usable triangle.

    Each triangle's tensor is the least-squares solution of how vertex normals change along its edges; it is turned
    into the frames of its vertices and averaged there by area.
    """
    out = np.zeros((len(p), 8))
    if not len(t):
        return out
    raw = cross(p, t)
    n = np.zeros_like(p)
    for k in range(3):
        np.add.at(n, t[:, k], raw)
    n = unit(n)
    e = np.stack([p[t[:, (k + 2) % 3]] - p[t[:, (k + 1) % 3]] for k in range(3)], 1)
    longest = np.linalg.norm(e, axis=2).max(1)
    twice = np.linalg.norm(raw, axis=1)
    ok = (longest > 1e-15) & (twice > 2e-4 * longest**2)
    hint = np.zeros_like(p)
    for k, edge in enumerate((p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 1]], p[t[:, 0]] - p[t[:, 2]])):
        hint[t[:, k]] = edge
    pu, pv = _frames(n, hint)
    t, e, raw, twice = t[ok], e[ok], raw[ok], twice[ok]
    if not len(t):
        return out
    fn = raw / twice[:, None]
    fu = e[:, 0] / np.linalg.norm(e[:, 0], axis=1, keepdims=True)
    fv = np.cross(fn, fu)
    a, b = np.zeros((len(t), 3, 3)), np.zeros((len(t), 3))
    for k in range(3):
        x, y = (e[:, k] * fu).sum(1), (e[:, k] * fv).sum(1)
        dn = n[t[:, (k + 2) % 3]] - n[t[:, (k + 1) % 3]]
        rows = ((x, y, 0 * x), (dn * fu).sum(1)), ((0 * x, x, y), (dn * fv).sum(1))
        for r, right in rows:
            r = np.stack(r, 1)
            a += r[:, :, None] * r[:, None, :]
            b += r * right[:, None]
    good = np.abs(np.linalg.det(a)) > 1e-30
    x = np.zeros_like(b)
    x[good] = np.linalg.solve(a[good], b[good][:, :, None])[:, :, 0]
    weight, tensor = np.zeros(len(p)), np.zeros((len(p), 3))
    for k in range(3):
        v = t[:, k]
        ru, rv = _turned(pu[v], pv[v], fn)
        u1, u2, v1, v2 = (ru * fu).sum(1), (ru * fv).sum(1), (rv * fu).sum(1), (rv * fv).sum(1)
        form = lambda q1, q2, w1, w2: x[:, 0] * q1 * w1 + x[:, 1] * (q1 * w2 + q2 * w1) + x[:, 2] * q2 * w2
        part = np.stack((form(u1, u2, u1, u2), form(u1, u2, v1, v2), form(v1, v2, v1, v2)), 1)
        np.add.at(tensor, v, part * (twice * good)[:, None])
        np.add.at(weight, v, twice * good)
    live = (weight > 1e-15) & np.isfinite(tensor).all(1)
    m = tensor[live] / weight[live][:, None]
    val, vec = np.linalg.eigh(np.stack((m[:, [0, 1]], m[:, [1, 2]]), 1))
    swap = np.abs(val[:, 0]) > np.abs(val[:, 1])
    first = np.where(swap, 0, 1)
    rows = np.arange(len(m))
    k1, k2 = val[rows, first], val[rows, 1 - first]
    d = [vec[rows, 0, f][:, None] * pu[live] + vec[rows, 1, f][:, None] * pv[live] for f in (first, 1 - first)]
    out[live] = np.concatenate((k1[:, None], k2[:, None], *d), 1)
    return out


CURVATURE = "mesh_id long, vid long, k1 double, k2 double, mean double, gaussian double, d1 array<double>, d2 array<double>"


def curvatures(mesh: Mesh) -> DataFrame:
    def run(mesh_id, p, t, ids):
        k = vertex_curvatures(p, t)
        return pd.DataFrame({"mesh_id": mesh_id, "vid": ids, "k1": k[:, 0], "k2": k[:, 1], "mean": k[:, :2].mean(1), "gaussian": k[:, 0] * k[:, 1], "d1": k[:, 2:5].tolist(), "d2": k[:, 5:].tolist()})

    return per_mesh(mesh, run, CURVATURE)


def slippage(p: np.ndarray, t: np.ndarray, most: int = 2000) -> dict:
    """The rigid motions that leave a region in place: kind, axis, pitch, eigenvalue ratios and confidence."""
    none = {"kind": "freeform", "axis_point": None, "axis_direction": None, "pitch": None, "ratios": [0.0] * 6, "confidence": 0.0}
    raw = cross(p, t)
    n, w = np.zeros_like(p), np.zeros(len(p))
    for k in range(3):
        np.add.at(n, t[:, k], raw)
        np.add.at(w, t[:, k], np.linalg.norm(raw, axis=1) / 6)
    used = np.nonzero(w > 0)[0]
    if len(used) < 6:
        return none
    if len(used) > most:
        used = used[np.unique(np.minimum(len(used) - 1, (np.arange(most) * len(used) / most).astype(int)))]
    q, n, w = p[used], unit(n[used]), w[used]
    centre = (q * w[:, None]).sum(0) / w.sum()
    size = float((q.max(0) - q.min(0)).max())
    if size <= 0:
        return none
    x = (q - centre) / size
    c = np.concatenate((np.cross(x, n), n), 1)
    val, vec = np.linalg.eigh((c * w[:, None]).T @ c)
    ratios = np.maximum(val, 0) / max(val[-1], 1e-300)
    d, gap = 0, 0.0
    for k in range(1, 6):
        g = ratios[k] - ratios[k - 1]
        if ratios[k - 1] < 0.02 and g >= 2e-4 and ratios[k] >= 3 * ratios[k - 1] and g > gap:
            d, gap = k, g
    out = none | {"ratios": ratios.tolist(), "confidence": float(min(1.0, gap / 0.02))}
    spin, move = vec[:3, :d].T, vec[3:, :d].T
    if d == 1:
        o, v = spin[0], move[0]
        if np.linalg.norm(o) < 1e-3:
            return out | {"kind": "extrusion", "axis_direction": (v / np.linalg.norm(v)).tolist()}
        along = o * (v @ o) / (o @ o)
        at = centre + size * np.cross(o, v - along) / (o @ o)
        axis = {"axis_point": at.tolist(), "axis_direction": (o / np.linalg.norm(o)).tolist()}
        slide = float(v @ o / np.linalg.norm(o))
        return out | axis | ({"kind": "revolution"} if abs(slide) < 1e-3 else {"kind": "helix", "pitch": slide / float(np.linalg.norm(o)) * size})
    if d in (2, 3):
        g = np.linalg.eigvalsh(spin @ spin.T)
        rank = int((g > 1e-2 * max(g.max(), 1e-300)).sum())
        o = spin[np.argmax(np.linalg.norm(spin, axis=1))]
        if (d, rank) == (3, 1):
            return out | {"kind": "plane", "axis_direction": (o / np.linalg.norm(o)).tolist()}
        if (d, rank) == (3, 3):
            m = np.concatenate([[[0, -s[2], s[1]], [s[2], 0, -s[0]], [-s[1], s[0], 0]] for s in spin])
            at = centre + size * np.linalg.lstsq(m, -move.reshape(-1), rcond=None)[0]
            return out | {"kind": "sphere", "axis_point": at.tolist()}
        if (d, rank) == (2, 1):
            v = move[np.argmax(np.linalg.norm(spin, axis=1))]
            along = o * (v @ o) / (o @ o)
            return out | {"kind": "cylinder", "axis_point": (centre + size * np.cross(o, v - along) / (o @ o)).tolist(), "axis_direction": (o / np.linalg.norm(o)).tolist()}
    return out


SLIPPAGE = "mesh_id long, kind string, axis_point array<double>, axis_direction array<double>, pitch double, ratios array<double>, confidence double"


def slippages(mesh: Mesh, most: int = 2000) -> DataFrame:
    """The slippage of every mesh taken as one region (use sub_mesh for parts)."""

    def run(mesh_id, p, t, ids):
        return pd.DataFrame([{"mesh_id": mesh_id, **slippage(p, t, most)}])

    return per_mesh(mesh, run, SLIPPAGE)


def crease_edges(mesh: Mesh, least_degrees: float = 30.0) -> DataFrame:
    """mesh_id, lo, hi, angle of the edges of two triangles that fold by at least ``least_degrees``. DataFrames only."""
    n = face_normals(mesh)
    h = halfedges(mesh.triangles).select("mesh_id", "lo", "hi", "tid").join(n.hint("merge"), ["mesh_id", "tid"])
    e = h.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "nx", "ny", "nz")).alias("a"), F.max(F.struct("tid", "nx", "ny", "nz")).alias("b")).where("n = 2")
    dot = sum(F.col(f"a.n{c}") * F.col(f"b.n{c}") for c in "xyz")
    e = e.select("mesh_id", "lo", "hi", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))).alias("angle"))
    return e.where(F.col("angle") >= least_degrees)


RINGS = "mesh_id long, ring_id int, vertices array<long>, closed boolean, length double, mean_angle double, max_angle double"


def crease_rings(mesh: Mesh, least_degrees: float = 30.0) -> DataFrame:
    """Crease edges chained between junctions and ends, then into pure rings; longer ones first."""
    at = mesh.vertices.select("mesh_id", "vid", "x", "y", "z")
    e = crease_edges(mesh, least_degrees)
    for k in ("lo", "hi"):
        e = e.join(at.select("mesh_id", F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in "xyz")).hint("merge"), ["mesh_id", k])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edge = {(a, b): (d, math.dist(x[:3], x[3:])) for a, b, d, *x in pdf[["lo", "hi", "angle", "lox", "loy", "loz", "hix", "hiy", "hiz"]].itertuples(index=False)}
        near: dict[int, list[int]] = {}
        for a, b in edge:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        used, chains = set(), []

        def walk(a: int, b: int) -> list[int]:
            out = [a, b]
            used.add((min(a, b), max(a, b)))
            while len(near[out[-1]]) == 2 and out[-1] != a:
                nxt = next((x for x in near[out[-1]] if (min(x, out[-1]), max(x, out[-1])) not in used), None)
                if nxt is None:
                    break
                used.add((min(nxt, out[-1]), max(nxt, out[-1])))
                out.append(nxt)
            return out

        starts = [(v, x) for v in sorted(near) if len(near[v]) != 2 for x in sorted(near[v])] + sorted(edge)
        for a, b in starts:
            if (min(a, b), max(a, b)) not in used:
                chains.append(walk(a, b))
        rows = []
        for c in chains:
            parts = [edge[min(x, y), max(x, y)] for x, y in zip(c, c[1:])]
            closed = len(c) > 2 and c[0] == c[-1]
            rows.append((c[:-1] if closed else c, closed, sum(s for _, s in parts), sum(d for d, _ in parts) / len(parts), max(d for d, _ in parts)))
        rows.sort(key=lambda r: (-r[2], min(r[0])))
        return pd.DataFrame([(key[0], i, *r) for i, r in enumerate(rows)], columns=[c.split()[0] for c in RINGS.split(", ")])

    return e.groupBy("mesh_id").applyInPandas(run, RINGS)
