"""Decimation by quadric error: quadrics as sums over corners, collapses per mesh."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.model import Mesh, bounds, corners, halfedges
from tessera.operators.buffers import shadow_indices
from tessera.operators.permesh import per_mesh


@dataclass(frozen=True)
class SimplifyOptions:
    target_triangles: int | None = None
    target_reduction: float | None = None
    error_cap: float | None = None
    preserve_boundary: bool = True

    def __post_init__(self):
        if (self.target_triangles is None) == (self.target_reduction is None):
            raise ValueError("give either target_triangles or target_reduction")
        if self.target_triangles is not None and self.target_triangles < 1:
            raise ValueError("target_triangles must be at least 1")
        if self.target_reduction is not None and not 0 <= self.target_reduction <= 1:
            raise ValueError("target_reduction must lie in 0 .. 1")
        if self.error_cap is not None and self.error_cap < 0:
            raise ValueError("error_cap must not be negative")

    def goal(self, triangles: int) -> int:
        return min(self.target_triangles, triangles) if self.target_triangles is not None else max(1, round(triangles * (1 - self.target_reduction)))


def simplify_scale(mesh: Mesh) -> DataFrame:
    """mesh_id, scale: the largest extent."""
    return bounds(mesh.vertices).select("mesh_id", F.col("extent").alias("scale"))


def vertex_quadrics(mesh: Mesh) -> DataFrame:
    """mesh_id, vid and the ten sums of the plane quadrics of its triangles, weighted by the root of twice their area. DataFrames only."""
    c = corners(mesh)
    raw = V.triangle_cross()
    c = c.select("mesh_id", "i0", "i1", "i2", *V.vec("a"), V.norm(raw).alias("len"), *V.named(raw, ("rx", "ry", "rz"))).toDF("mesh_id", "i0", "i1", "i2", "ax", "ay", "az", "len", "rx", "ry", "rz").where("len > 0")
    n = {k: F.col("r" + k) / F.col("len") for k in "xyz"}
    d = -(n["x"] * F.col("ax") + n["y"] * F.col("ay") + n["z"] * F.col("az"))
    w = F.sqrt("len")
    q = {"qxx": n["x"] * n["x"], "qyy": n["y"] * n["y"], "qzz": n["z"] * n["z"], "qxy": n["x"] * n["y"], "qxz": n["x"] * n["z"], "qyz": n["y"] * n["z"], "qx": n["x"] * d, "qy": n["y"] * d, "qz": n["z"] * d, "qc": d * d}
    rows = c.select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), *((w * v).alias(k) for k, v in q.items()), w.alias("qw"))
    return rows.groupBy("mesh_id", "vid").agg(*(F.sum(k).alias(k) for k in (*q, "qw")))


#: Weights of the border's and the point quadrics beside those of the faces; fixed values.
BORDER_WEIGHT, POINT_WEIGHT = 10.0, 1e-7
MANIFOLD, BORDER, LOCKED = 0, 1, 2


def vertex_kinds(mesh: Mesh) -> DataFrame:
    """mesh_id, vid, kind of the vertices in use (first of their place): ``manifold`` without open half-edges, ``border`` with one to
    it and one from it, ``locked`` with more or in a triangle that has a corner twice. A half-edge is open if none runs back. DataFrames only."""
    h = halfedges(shadow_indices(mesh)).select("mesh_id", "src", "dst")
    once = h.groupBy("mesh_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(
        F.max(F.col("src") <= F.col("dst")).alias("up"), F.max(F.col("src") >= F.col("dst")).alias("down")
    )
    twice = F.col("lo") == F.col("hi")
    leaves, enters = (F.when(twice, 2).when(F.col("up") & F.col("down"), 0).otherwise(F.col(c).cast("int")) for c in ("up", "down"))
    ends = F.array(F.struct(F.col("lo").alias("vid"), leaves.alias("out"), enters.alias("into")), F.struct(F.col("hi").alias("vid"), enters.alias("out"), leaves.alias("into")))
    n = once.select("mesh_id", F.inline(ends)).groupBy("mesh_id", "vid").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    kind = F.when((F.col("out") == 0) & (F.col("into") == 0), "manifold").when((F.col("out") <= 1) & (F.col("into") <= 1), "border").otherwise("locked")
    return n.select("mesh_id", "vid", kind.alias("kind"))


def border_quadrics(mesh: Mesh) -> DataFrame:
    """mesh_id, vid and the ten sums of the border's quadrics, with their weight: for each open half-edge that ends at a border vertex
    (of the kinds above) the plane upright on it, weighted by its length, and its triangle's plane, at both ends. DataFrames only."""
    welded = Mesh(mesh.vertices, shadow_indices(mesh))
    ends = [(k, (k + 1) % 3, (k + 2) % 3) for k in range(3)]
    turns = F.array(*(F.struct(*(F.col(f"i{c}").alias(n) for n, c in zip(("src", "dst"), (u, v))), *(F.col("abc"[c] + x).cast("double").alias(n + x) for n, c in zip("pqr", (u, v, w)) for x in "xyz")) for u, v, w in ends))
    h = corners(welded).select("mesh_id", F.inline(turns))
    back = h.select("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    border = vertex_kinds(mesh).where("kind = 'border'").select("mesh_id", "vid")
    ends = F.array(F.struct(F.col("src").alias("vid")), F.struct(F.col("dst").alias("vid")))
    opened = h.join(back.hint("merge"), ["mesh_id", "src", "dst"], "left_anti")
    near = opened.select("mesh_id", "src", "dst", F.inline(ends)).join(border.hint("merge"), ["mesh_id", "vid"], "left_semi").select("mesh_id", "src", "dst").distinct()
    along, across = V.sub(V.vec("q"), V.vec("p")), V.sub(V.vec("r"), V.vec("p"))
    square, share = V.dot(along, along), V.dot(across, along)
    upright = [a - b * share / F.when(square > 0, square).otherwise(1.0) for a, b in zip(across, along)]
    o = opened.join(near.hint("merge"), ["mesh_id", "src", "dst"], "left_semi")
    planes = ((upright, F.sqrt(square), 1.0), (V.cross(along, across), F.sqrt(V.norm(V.cross(along, across))), 0.0))
    rows = [F.struct(*V.named(n), w.alias("weight"), F.lit(counts).alias("counts")) for n, w, counts in planes]
    each = o.select("mesh_id", "src", "dst", "px", "py", "pz", F.inline(F.array(*rows))).where("nx * nx + ny * ny + nz * nz > 0")
    each = each.select("*", F.explode(F.array("src", "dst")).alias("vid"), V.norm(V.vec("n")).alias("size"))
    x, y, z = (F.col("n" + c) / F.col("size") for c in "xyz")
    d = -(x * F.col("px") + y * F.col("py") + z * F.col("pz"))
    sums = {"qxx": x * x, "qyy": y * y, "qzz": z * z, "qxy": x * y, "qxz": x * z, "qyz": y * z, "qx": x * d, "qy": y * d, "qz": z * d, "qc": d * d, "qw": F.col("counts")}
    return each.groupBy("mesh_id", "vid").agg(*(F.sum(BORDER_WEIGHT * F.col("weight") * v).alias(k) for k, v in sums.items()))


def _around(lists: tuple[np.ndarray, np.ndarray, np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in v, triangle) of every triangle around each of the vertices v."""
    tri, start, count = lists
    k = count[v]
    owner = np.repeat(np.arange(len(v)), k)
    return owner, tri[np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k) + start[v][owner]]


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _edges(t: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower end, higher end, +1 where open upwards, -1 where open downwards, 0 where half-edges run both ways) of the edges."""
    src, dst = t.reshape(-1), t[:, [1, 2, 0]].reshape(-1)
    key = _distinct((np.minimum(src, dst) * n + np.maximum(src, dst)) * 2 + (src > dst))
    edge, down = key >> 1, (key & 1).astype(bool)
    first = np.ones(len(edge), bool)
    first[1:] = edge[1:] != edge[:-1]
    paired = np.append(~first[1:], False)[first]
    return edge[first] // n, edge[first] % n, np.where(paired, 0, np.where(down[first], -1, 1))


def _planes(normal: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Plane quadrics: the ten sums xx yy zz xy xz yz x y z 1 and the weight."""
    x, y, z = normal.T
    d = -(normal * at).sum(1)
    return np.stack((x * x, y * y, z * z, x * y, x * z, y * z, x * d, y * d, z * d, d * d, np.ones(len(d))), 1) * weight[:, None]


def _error(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, c = x.T
    e = q[:, 0] * a * a + q[:, 1] * b * b + q[:, 2] * c * c + 2 * (q[:, 3] * a * b + q[:, 4] * a * c + q[:, 5] * b * c + q[:, 6] * a + q[:, 7] * b + q[:, 8] * c) + q[:, 9]
    return np.abs(e) / np.maximum(q[:, 10], 1e-300)


def _unit_cross(x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.cross(x[t[:, 1]] - x[t[:, 0]], x[t[:, 2]] - x[t[:, 0]])
    length = np.sqrt((raw * raw).sum(1))
    return raw / np.where(length > 0, length, 1)[:, None], length


def _sums(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, c, n) for c in rows.T], 1) if len(of) else np.zeros((n, rows.shape[1]))


def _quadrics(x: np.ndarray, t: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Of every vertex: its faces' planes, and planes upright on its open edges, mixed with the face's there."""
    n, length = _unit_cross(x, t)
    face = _planes(n, x[t[:, 0]], np.sqrt(length))
    quad = sum(_sums(t[:, k], face, len(x)) for k in range(3))
    if not (kind == BORDER).any():
        return quad
    lo, hi, way = _edges(t, len(x))
    opened = _distinct(np.where(way > 0, lo * len(x) + hi, hi * len(x) + lo)[way != 0])
    for k in range(3):
        a, b, c = (t[:, (k + j) % 3] for j in range(3))
        f = np.nonzero(((kind[a] == BORDER) | (kind[b] == BORDER)) & np.isin(a * len(x) + b, opened))[0]
        a, b, c = a[f], b[f], c[f]
        along, across = x[b] - x[a], x[c] - x[a]
        square = (along * along).sum(1)
        upright = across - along * ((across * along).sum(1) / np.where(square > 0, square, 1))[:, None]
        size = np.sqrt((upright * upright).sum(1))
        edge = _planes(upright / np.where(size > 0, size, 1)[:, None], x[a], BORDER_WEIGHT * np.sqrt(square))
        edge[:, :10] += BORDER_WEIGHT * face[f, :10]
        quad += _sums(a, edge, len(x)) + _sums(b, edge, len(x))
    return quad


def _kinds(t: np.ndarray, n: int) -> np.ndarray:
    lo, hi, way = _edges(t, n)
    leaves = np.bincount(np.where(way > 0, lo, hi)[way != 0], minlength=n)
    enters = np.bincount(np.where(way > 0, hi, lo)[way != 0], minlength=n)
    kind = np.where((leaves > 1) | (enters > 1), LOCKED, np.where((leaves > 0) | (enters > 0), BORDER, MANIFOLD))
    kind[t[(t == t[:, [1, 2, 0]]).any(1)].reshape(-1)] = LOCKED
    return kind


def _sound(x: np.ndarray, t: np.ndarray, lists, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a may move onto b, triangles that vanish): no triangle turns by more than acos(0.25), and a and b have only those
    neighbours in common that share a triangle with both."""
    owner, f = _around(lists, a)
    tri = t[f]
    gone = (tri == b[owner][:, None]).any(1)
    shared = np.bincount(owner[gone], minlength=len(a))
    stay, who = tri[~gone], owner[~gone]
    before = np.cross(x[stay[:, 1]] - x[stay[:, 0]], x[stay[:, 2]] - x[stay[:, 0]])
    p = [np.where((stay[:, k] == a[who])[:, None], x[b[who]], x[stay[:, k]]) for k in range(3)]
    after = np.cross(p[1] - p[0], p[2] - p[0])
    turned = (before * after).sum(1) <= 0.25 * np.sqrt((before * before).sum(1) * (after * after).sum(1))
    ok = np.bincount(who[turned], minlength=len(a)) == 0
    near = [_distinct(np.repeat(o, 3) * len(x) + t[g].reshape(-1)) for o, g in ((owner, f), _around(lists, b))]
    both = np.intersect1d(*near, assume_unique=True) // len(x)
    return ok & (np.bincount(both, minlength=len(a)) == 2 + shared), shared


def _least_near(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = value.copy()
    np.minimum.at(out, lo, value[hi])
    np.minimum.at(out, hi, value[lo])
    return out


def _collapses(x, t, kind, quad, point, limit: float, room: int) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass: (vertices that move, where to, greatest error). Of all collapses the cheapest within two edges are taken, again and
    again among those not near one taken, so that no two touch; none costs more than 1.5 times what the goal would need if all could be done."""
    n = len(x)
    lo, hi, way = _edges(t, n)
    flat = t.reshape(-1)
    count = np.bincount(flat, minlength=n)
    lists = np.argsort(flat, kind="stable") // 3, np.cumsum(count) - count, count
    a, b, opened = np.concatenate((lo, hi)), np.concatenate((hi, lo)), np.concatenate((way, way)) != 0
    may = (a != b) & ((kind[a] == MANIFOLD) | (kind[a] == BORDER) & opened & (kind[b] != MANIFOLD))
    a, b = a[may], b[may]
    flatness = _error(quad[a], x[b])
    spread = point[a]  # weighted sums 1, p, p * p of the places that a stands for
    rank_by = flatness + POINT_WEIGHT * (spread[:, 4] - 2 * (spread[:, 1:4] * x[b]).sum(1) + spread[:, 0] * (x[b] * x[b]).sum(1)) / np.maximum(quad[a, 10], 1e-300)
    keep = flatness <= limit
    a, b, flatness, rank_by = a[keep], b[keep], flatness[keep], rank_by[keep]
    if not len(a):
        return a, b, 0.0
    at = min(room, len(a) - 1)
    goal = 1.5 * np.partition(rank_by, at)[at]
    for within in (rank_by <= goal, rank_by > goal):
        order = np.nonzero(within)[0]
        order = order[np.argsort(rank_by[order], kind="stable")]
        live, taken, removed = np.arange(len(order)), [], 0
        ca, cb = a[order], b[order]
        while len(live) and removed < room:
            best = np.full(n, len(order))
            np.minimum.at(best, ca[live], live)
            near = _least_near(_least_near(best, lo, hi), lo, hi)
            chosen = live[near[ca[live]] == live]
            ok, shared = _sound(x, t, lists, ca[chosen], cb[chosen])
            before = removed + np.cumsum(np.where(ok, shared, 0)) - np.where(ok, shared, 0)
            ok &= before < room
            few = removed > 0 and 32 * int(shared[ok].sum()) < removed  # what is left here is better sought in the next pass
            removed += int(shared[ok].sum())
            taken.append(chosen[ok])
            if few:
                break
            blocked = np.ones(n, int)
            blocked[ca[chosen[ok]]] = 0
            blocked = _least_near(_least_near(blocked, lo, hi), lo, hi)
            refused = np.zeros(len(order), bool)
            refused[chosen] = True
            live = live[(blocked[ca[live]] == 1) & ~refused[live]]
        done = np.concatenate(taken) if taken else np.zeros(0, int)
        if len(done):
            return ca[done], cb[done], float(flatness[order[done]].max())
    return a[:0], b[:0], 0.0


def simplify(p: np.ndarray, t: np.ndarray, o: SimplifyOptions) -> tuple[np.ndarray, float]:
    """(triangles left, error): passes of collapses onto existing vertices, the cheapest first; borders stay if so asked, and else
    move only along themselves. Quadrics add up where vertices meet. Equal places count as one vertex.

    The error is the root of the largest accepted quadric error, in the mesh's own units; no collapse exceeds the cap.
    """
    goal, cap = o.goal(len(t)), math.inf if o.error_cap is None else o.error_cap
    if len(t) <= goal or not len(t):
        return t, 0.0
    scale = float((p.max(0) - p.min(0)).max()) or 1.0
    x = (p - p.min(0)) / scale
    order = np.lexsort((np.arange(len(x)), x[:, 2], x[:, 1], x[:, 0]))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]).any(1)
    of = np.empty(len(x), int)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    x, tri = x[first], of[t]
    kind = _kinds(tri, len(x))
    quad = _quadrics(x, tri, np.where(kind == BORDER, LOCKED, kind) if o.preserve_boundary else kind)
    if o.preserve_boundary:
        kind = np.where(kind == BORDER, LOCKED, kind)
    w = quad[:, 10]
    point = np.concatenate((w[:, None], w[:, None] * x, (w * (x * x).sum(1))[:, None]), 1)
    worst = 0.0
    while len(tri) > goal:
        a, b, error = _collapses(x, tri, kind, quad, point, (cap / scale) ** 2, len(tri) - goal)
        if not len(a):
            break
        worst = max(worst, error)
        quad[b] += quad[a]
        point[b] += point[a]
        to = np.arange(len(x))
        to[a] = b
        tri = to[tri]
        tri = tri[(tri != tri[:, [1, 2, 0]]).all(1)]
    return first[tri], math.sqrt(worst) * scale


SIMPLIFIED = "mesh_id long, before long, after long, error double, vertices array<array<double>>, triangles array<array<long>>"


def simplified(mesh: Mesh, options: SimplifyOptions) -> DataFrame:
    """One row per mesh: counts, error, and the new mesh with vertices in order of first use. Meshes without a triangle give none."""

    def run(mesh_id, p, t, ids):
        if not len(t):
            return pd.DataFrame(columns=[c.split()[0] for c in SIMPLIFIED.split(", ")])
        out, error = simplify(p, t, options)
        used, first, inverse = np.unique(out.reshape(-1), return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        row = (mesh_id, len(t), len(out), error, p[used[order]].tolist(), rank[inverse].reshape(-1, 3).tolist())
        return pd.DataFrame([row], columns=[c.split()[0] for c in SIMPLIFIED.split(", ") if c.split()[0].isidentifier()])

    return per_mesh(mesh, run, SIMPLIFIED)
