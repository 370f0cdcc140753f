"""Rigid alignment by point-to-plane iterations, many pairs at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import Mesh
from tessera.operators.permesh import cross, unit, weld


@dataclass(frozen=True)
class AlignOptions:
    max_iterations: int = 50
    cap: float | None = None
    trim: float = 0.1
    pre_align: bool = True
    normal_space: bool = False
    max_samples: int = 2000


class Nearest:
    """Exact nearest neighbours by a grid whose rings of cells are searched outwards; the lower index on ties."""

    def __init__(self, p: np.ndarray):
        self.p, self.lo = p, p.min(0)
        self.cell = max(float((p.max(0) - p.min(0)).max()) / max(1.0, len(p) ** (1 / 2)), 1e-12)
        self.cells: dict[tuple, list[int]] = {}
        for i, k in enumerate(map(tuple, np.floor((p - self.lo) / self.cell).astype(int))):
            self.cells.setdefault(k, []).append(i)
        self.top = np.floor((p.max(0) - self.lo) / self.cell).astype(int)

    def query(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.empty(len(q), int)
        for at in range(0, len(q), 256):  # blocks of exact distances: a block is 256 x the reference's points
            d = ((q[at : at + 256, None, :] - self.p[None]) ** 2).sum(2) if len(self.p) <= 4096 else None
            if d is not None:
                near[at : at + 256] = d.argmin(1)
            else:
                near[at : at + 256] = [self._one(x) for x in q[at : at + 256]]
        return near, np.linalg.norm(q - self.p[near], axis=1)

    def _one(self, x: np.ndarray) -> int:
        k = np.clip(np.floor((x - self.lo) / self.cell).astype(int), 0, self.top)
        out = np.linalg.norm(x - np.clip(x, self.lo, self.lo + (self.top + 1) * self.cell))
        best, most, ring = (np.inf, -1), int(self.top.max()) + 1, 0
        while ring <= most:
            for a in range(-ring, ring + 1):
                for b in range(-ring, ring + 1):
                    for c in (range(-ring, ring + 1) if max(abs(a), abs(b)) == ring else (-ring, ring)):
                        for i in self.cells.get((k[0] + a, k[1] + b, k[2] + c), ()):
                            best = min(best, (float(((x - self.p[i]) ** 2).sum()), i))
            if best[1] >= 0 and np.sqrt(best[0]) <= max(0.0, ring * self.cell - out):
                break
            ring += 1
        return best[1]


def rodrigues(w: np.ndarray) -> np.ndarray:
    a = float(np.linalg.norm(w))
    if a < 1e-15:
        return np.eye(3)
    x, y, z = w / a
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * (k @ k)


def normal_space_sample(n: np.ndarray, most: int) -> np.ndarray:
    """Places taken in turn from 12 x 6 buckets of normals by latitude, then longitude."""
    lon = np.minimum(11, ((np.arctan2(n[:, 1], n[:, 0]) + np.pi) / (2 * np.pi) * 12).astype(int))
    lat = np.minimum(5, ((np.arcsin(np.clip(n[:, 2], -1, 1)) + np.pi / 2) / np.pi * 6).astype(int))
    key = lat * 12 + lon
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(n), int)
    rank[order] = np.arange(len(n)) - np.searchsorted(key[order], key[order])
    return np.lexsort((key, rank))[:most]


def uniform_sample(total: int, take: int) -> np.ndarray:
    return np.unique(np.minimum(total - 1, (np.arange(take) * total / take).astype(int)))


def align(sp, st, rp, rt, o: AlignOptions = AlignOptions()) -> dict | None:
    """transform (column-major 4 x 4), residual_rms, iterations, converged; None with fewer than three points on a side."""
    sm, sf = weld(sp)
    rm, rf = weld(rp)
    s, r = sp[sf], rp[rf]
    if len(s) < 3 or len(r) < 3:
        return None

    def normals(p, t):
        n = np.zeros_like(p)
        for k in range(3):
            np.add.at(n, t[:, k], cross(p, t))
        return unit(n)

    sn, rn = normals(s, sm[st]), normals(r, rm[rt])
    diag = float(np.linalg.norm(r.max(0) - r.min(0)))
    cap = max(1e-9, 0.15 * diag) if o.cap is None else o.cap
    near = Nearest(r)
    if len(s) > o.max_samples:
        s = s[normal_space_sample(sn, o.max_samples) if o.normal_space else uniform_sample(len(s), o.max_samples)]
    rot, move = np.eye(3), np.zeros(3)
    if o.pre_align:
        frames = []
        for p in (s, r):
            _, vec = np.linalg.eigh(np.cov(p.T))
            frames.append((p.mean(0), vec[:, 2], vec[:, 1]))
        best = np.inf
        step = max(1, len(s) // 200)
        for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
            to = np.stack((a * frames[1][1], b * frames[1][2], np.cross(a * frames[1][1], b * frames[1][2])), 1)
            of = np.stack((frames[0][1], frames[0][2], np.cross(frames[0][1], frames[0][2])), 1)
            q = to @ of.T
            d = frames[1][0] - q @ frames[0][0]
            score = near.query(s[::step] @ q.T + d)[1].mean()
            if score < best:
                best, rot, move = score, q, d
    last, done, i = np.inf, False, 0
    for i in range(o.max_iterations):
        x = s @ rot.T + move
        k, dist = near.query(x)
        ok = np.nonzero(dist <= cap)[0]
        if len(ok) < 6:
            break
        gap = ((x[ok] - r[k[ok]]) * rn[k[ok]]).sum(1)
        rms = float(np.sqrt((gap**2).mean()))
        if i and abs(rms - last) < max(1e-12, 1e-7 * diag):
            done = True
            break
        last = rms
        keep = max(6, round(len(ok) * (1 - min(0.9, max(0.0, o.trim)))))
        sel = ok[np.argsort(dist[ok], kind="stable")[:keep]]
        n = rn[k[sel]]
        a = np.concatenate((np.cross(x[sel], n), n), 1)
        b = -((x[sel] - r[k[sel]]) * n).sum(1)
        m = a.T @ a
        if np.linalg.matrix_rank(m) < 6:
            m = m + 1e-9 * np.trace(m) * np.eye(6)
        w = np.linalg.solve(m, a.T @ b)
        q = rodrigues(w[:3])
        rot, move = q @ rot, q @ move + w[3:]
    x = s @ rot.T + move
    k, dist = near.query(x)
    ok = dist <= cap
    rms = float(np.sqrt((((x - r[k]) * rn[k]).sum(1)[ok] ** 2).mean())) if ok.any() else float("inf")
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = rot, move
    return {"transform": pose.T.reshape(-1).tolist(), "residual_rms": rms, "iterations": i, "converged": done}


ALIGNED = "pair_id long, transform array<double>, residual_rms double, iterations int, converged boolean"


def aligned(source: Mesh, reference: Mesh, pairs: DataFrame, options: AlignOptions = AlignOptions()) -> DataFrame:
    """One row per pair of pairs(pair_id, source_mesh_id, reference_mesh_id); each pair is a task of its own."""

    def side(mesh: Mesh, key: str) -> DataFrame:
        ids = pairs.select("pair_id", F.col(key).alias("mesh_id"))
        v = mesh.vertices.groupBy("mesh_id").agg(F.sort_array(F.collect_list(F.struct("vid", "x", "y", "z"))).alias("v"))
        t = mesh.triangles.groupBy("mesh_id").agg(F.sort_array(F.collect_list(F.struct("tid", "i0", "i1", "i2"))).alias("t"))
        return ids.join(v.hint("merge"), "mesh_id").join(t.hint("merge"), "mesh_id").drop("mesh_id")

    both = side(source, "source_mesh_id").join(side(reference, "reference_mesh_id").withColumnsRenamed({"v": "rv", "t": "rt"}).hint("merge"), "pair_id")

    def run(frames):
        for pdf in frames:
            rows = []
            for pair, v, t, rv, rt in pdf[["pair_id", "v", "t", "rv", "rt"]].itertuples(index=False):
                got = []
                for vs, ts in ((v, t), (rv, rt)):
                    ids = np.array([x["vid"] for x in vs])
                    got += [np.array([[x["x"], x["y"], x["z"]] for x in vs], float), np.searchsorted(ids, np.array([[x["i0"], x["i1"], x["i2"]] for x in ts]))]
                res = align(*got, options)
                if res:
                    rows.append({"pair_id": pair, **res})
            yield pd.DataFrame(rows, columns=["pair_id", "transform", "residual_rms", "iterations", "converged"])

    return both.mapInPandas(run, ALIGNED)
