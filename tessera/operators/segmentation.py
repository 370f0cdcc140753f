"""Surface segmentation: smooth growing, fit-gated merging, RANSAC shapes, and the choice between them."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.model import Mesh, corners
from tessera.operators import fitting
from tessera.operators.graph import components
from tessera.operators.permesh import Sets, cross, neighbour_pairs, per_mesh, unit, weld

#: Sampled fits times triangles that are tried at once.
BATCH = 1 << 15


@dataclass(frozen=True)
class SegmentOptions:
    max_dihedral: float = 20.0
    merge_tolerance: float = 0.004
    max_merge_angle: float = 50.0
    min_region_triangles: int = 1
    max_regions: int | None = None
    weld_tolerance: float = 0.0
    curvature_seeding: bool = False


@dataclass(frozen=True)
class RansacOptions:
    inlier_epsilon: float = 0.0
    cluster_epsilon: float = 0.0
    normal_angle: float = 25.0
    min_support: int = 30
    probability: float = 0.99
    max_candidates: int = 300
    sample_size: int = 6
    max_regions: int | None = None
    weld_tolerance: float = 0.0


def smooth_regions(mesh: Mesh, max_dihedral: float = 20.0) -> DataFrame:
    """mesh_id, tid, label: components of triangles over edges that bend by at most ``max_dihedral`` degrees. DataFrames only."""
    ends = F.array(*(F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))))
    h = corners(mesh).select("mesh_id", "tid", *V.named(V.unit(V.triangle_cross())), F.inline(ends))
    # the triangles of an edge are few: gathered once, normals aren't made for either side of a join
    e = h.groupBy("mesh_id", "lo", "hi").agg(F.collect_list(F.struct("tid", "nx", "ny", "nz")).alias("at")).where(F.size("at") > 1)
    p = e.select("mesh_id", "at", F.inline("at")).select("mesh_id", "tid", "nx", "ny", "nz", F.explode("at").alias("o")).where("tid < o.tid")
    p = p.select("mesh_id", "tid", "nx", "ny", "nz", F.col("o.tid").alias("other"), *(F.col(f"o.n{c}").alias("m" + c) for c in "xyz"))
    p = p.where(V.dot(V.vec("n"), V.vec("m")) >= math.cos(math.radians(max_dihedral)))
    nodes = mesh.triangles.select("mesh_id", F.col("tid").alias("node"))
    return components(nodes, p.select("mesh_id", F.col("tid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "tid")


def _grown(t: np.ndarray, n: np.ndarray, o: SegmentOptions, order: Iterable[int] | None) -> list[list[int]]:
    first, second, _ = neighbour_pairs(t)
    least = math.cos(math.radians(o.max_dihedral))
    if order is None:
        sets = Sets(len(t))
        smooth = (n[first] * n[second]).sum(1) >= least
        for a, b in zip(first[smooth].tolist(), second[smooth].tolist()):
            sets.join(a, b)
        groups: dict[int, list[int]] = {}
        for i in range(len(t)):
            groups.setdefault(sets.find(i), []).append(i)
        return list(groups.values())
    near: list[list[int]] = [[] for _ in range(len(t))]
    for a, b in zip(first.tolist(), second.tolist()):
        near[a].append(b)
        near[b].append(a)
    taken, out = np.zeros(len(t), bool), []
    for seed in order:
        if taken[seed]:
            continue
        taken[seed], group, work = True, [], [seed]
        while work:
            a = work.pop()
            group.append(a)
            for b in near[a]:
                if not taken[b] and n[seed] @ n[b] >= least:
                    taken[b] = True
                    work.append(b)
        out.append(sorted(group))
    return out


def _fit(p: np.ndarray, t: np.ndarray, n: np.ndarray, rows: list[int]) -> fitting.Fit:
    return fitting.best_fit(p[np.unique(t[rows])], n[rows])


def _merged(p, t, welded, n, regions: list[list[int]], o: SegmentOptions, diag: float):
    """Regions joined in order of the flattest shared edge while the union fits as well, until no pair does; (regions, fits)."""
    tolerance, least = max(o.merge_tolerance * diag, 1e-6), math.cos(math.radians(o.max_merge_angle))
    first, second, _ = neighbour_pairs(welded)
    bend = (n[first] * n[second]).sum(1)

    def steps() -> list[tuple[int, int]]:
        """Pairs of regions whose sharpest shared edge is flat enough, the flattest first."""
        own = np.zeros(len(t), int)
        for k, r in enumerate(regions):
            own[r] = k
        x, y = own[first], own[second]
        lo, hi, d = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y], np.minimum(bend[x != y], 1.0)
        order = np.lexsort((d, hi, lo))
        lo, hi, d = lo[order], hi[order], d[order]
        sharpest = np.ones(len(d), bool)
        sharpest[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        lo, hi, d = (c[sharpest & (d >= least)] for c in (lo, hi, d))
        order = np.lexsort((hi, lo, -d))
        return list(zip(lo[order].tolist(), hi[order].tolist()))

    fits = [_fit(p, t, n, r) for r in regions]
    while True:
        now, changed = list(range(len(regions))), False
        for a, b in steps():
            while now[a] != a:
                a = now[a]
            while now[b] != b:
                b = now[b]
            if a == b:
                continue
            union = sorted(regions[a] + regions[b])
            f = _fit(p, t, n, union)
            if f.rms <= tolerance and f.rms <= min(fits[a].rms, fits[b].rms) + 0.5 * tolerance:
                a, b = min(a, b), max(a, b)
                regions[a], fits[a], regions[b], now[b], changed = union, f, [], a, True
        fits = [f for r, f in zip(regions, fits) if r]
        regions = [r for r in regions if r]
        if not changed:
            return regions, fits


def segment(p: np.ndarray, t: np.ndarray, o: SegmentOptions, seeds: np.ndarray | None = None):
    """(regions, fits, triangles left out, whether merging was skipped: it never is) of one mesh."""
    if not len(t):
        return [], [], 0, False
    diag = float(np.linalg.norm(p.max(0) - p.min(0)))
    remap, _ = weld(p, o.weld_tolerance)
    welded, n = remap[t], unit(cross(p, t))
    regions, fits = _merged(p, t, welded, n, _grown(welded, n, o, seeds), o, diag)
    both = sorted(((r, f) for r, f in zip(regions, fits) if len(r) >= o.min_region_triangles), key=lambda x: (-len(x[0]), min(x[0])))
    both = both if o.max_regions is None else both[: max(0, o.max_regions)]
    return [r for r, _ in both], [f for _, f in both], len(t) - sum(len(r) for r, _ in both), False


def splitmix64(x: int) -> int:
    mask = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & mask
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
    return x ^ x >> 31


def sample(pool: int, count: int, trial: int) -> list[int]:
    """``count`` distinct places below ``pool`` that the trial's number decides."""
    out: list[int] = []
    for salt in range(4 * pool + 64):
        k = splitmix64((trial * 0x9E3779B97F4A7C15 + salt) & ((1 << 64) - 1)) % pool
        if k not in out:
            out.append(k)
            if len(out) == count:
                break
    return out


def needed_trials(ratio: float, probability: float, size: int, cap: int) -> int:
    if not 0 < ratio < 1:
        return cap
    return min(cap, max(1, math.ceil(math.log(1 - probability) / math.log(1 - ratio**size))))


def clusters(p: np.ndarray, eps: float) -> list[list[int]]:
    """Groups of points that steps of at most eps connect, by a grid of that width."""
    if eps <= 0:
        return [[i] for i in range(len(p))]
    cells: dict[tuple, list[int]] = {}
    keys = np.floor(p / eps).astype(int)
    for i, k in enumerate(map(tuple, keys)):
        cells.setdefault(k, []).append(i)
    sets = Sets(len(p))
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    for k, own in cells.items():
        for d in steps:
            other = cells.get((k[0] + d[0], k[1] + d[1], k[2] + d[2]))
            if other:
                gap = np.linalg.norm(p[own][:, None] - p[other][None], axis=2) <= eps
                for i, j in zip(*np.nonzero(gap)):
                    sets.join(own[i], other[j])
    groups: dict[int, list[int]] = {}
    for i in range(len(p)):
        groups.setdefault(sets.find(i), []).append(i)
    return list(groups.values())


def ransac(p: np.ndarray, t: np.ndarray, o: RansacOptions):
    """(regions, fits, triangles left out) of the shapes that sampled fits find, the best of each round first."""
    if not len(t):
        return [], [], 0
    remap, first = weld(p, o.weld_tolerance)
    w = p[first][remap]
    diag = float(np.linalg.norm(p.max(0) - p.min(0)))
    eps = o.inlier_epsilon if o.inlier_epsilon > 0 else max(1e-9, 0.005 * diag)
    edge = float(np.mean([np.linalg.norm(w[t[:, i]] - w[t[:, (i + 1) % 3]], axis=1) for i in range(3)]))
    reach = o.cluster_epsilon if o.cluster_epsilon > 0 else max(1e-9, 2 * edge)
    n, mid, least = unit(cross(w, t)), p[t].mean(1), math.cos(math.radians(o.normal_angle))
    rest, found, trial = np.arange(len(t)), [], 0

    def inliers(kind: str, params) -> np.ndarray:
        return rest[fitting.holds(kind, np.array([params]), mid[rest], n[rest], eps, least)[0]]

    while len(rest) >= max(o.min_support, o.sample_size):
        most, best_fit, budget, done = 0, None, o.max_candidates, 0
        tries: list[list[tuple[int, str, np.ndarray]]] = []
        ahead = 4
        while done < budget:
            if not tries:  # fits of several trials at once, taken up one trial after the other
                ahead = min(2 * ahead, max(1, BATCH // len(rest)))
                rows = np.array([rest[sample(len(rest), o.sample_size, trial + 1 + k)] for k in range(min(budget - done, ahead))])
                tries = [[] for _ in rows]
                for kind, ok, params in fitting.sampled_fits(p, t[rows], n[rows]):
                    count = fitting.holds(kind, params, mid[rest], n[rest], eps, least).sum(1)
                    for k in np.nonzero(ok)[0].tolist():
                        tries[k].append((int(count[k]), kind, params[k]))
                tries.reverse()
            done, trial = done + 1, trial + 1
            for count, kind, params in tries.pop():
                if count > most:
                    most, best_fit = count, (kind, params)
                    budget = needed_trials(most / len(rest), o.probability, o.sample_size, o.max_candidates)
            if most == len(rest):  # no later trial of this round can find more
                trial += max(0, budget - done)
                break
        best = inliers(*best_fit) if most else rest[:0]
        if len(best) < o.min_support:
            break
        for f in fitting.all_fits(p[np.unique(t[best])], n[best]):
            if f.kind == best_fit[0] and len(got := inliers(f.kind, f.params)) > len(best):
                best = got
        taken = [best[g] for g in clusters(mid[best], reach) if len(g) >= o.min_support]
        if not taken:
            break
        found += [sorted(g.tolist()) for g in taken]
        rest = np.setdiff1d(rest, np.concatenate(taken))
    found.sort(key=lambda r: (-len(r), r[0]))
    found = found if o.max_regions is None else found[: max(0, o.max_regions)]
    return found, [_fit(p, t, n, r) for r in found], len(t) - sum(map(len, found))


def coverage(p: np.ndarray, t: np.ndarray, regions: list[list[int]], fits: list[fitting.Fit]) -> float:
    """Share of the area in regions of at least 1 % of it whose fit holds for 0.8 of their points."""
    a = 0.5 * np.linalg.norm(cross(p, t), axis=1)
    total = float(a.sum())
    if total <= 1e-15:
        return 0.0
    own = [float(a[r].sum()) for r in regions]
    return sum(x for x, f in zip(own, fits) if f.inliers >= 0.8 and x >= 0.01 * total) / total


REGIONS = "mesh_id long, strategy string, region_id long, tids array<long>, n_tri long, area double, kind string, params array<double>, rms double, most double, inliers double, left_out long, skipped boolean, score double"


def ways(p: np.ndarray, t: np.ndarray, o: SegmentOptions | RansacOptions, auto: bool) -> list[tuple]:
    """(name, regions, fits, triangles left out, skipped) of the ways that ``o`` and ``auto`` ask for."""
    out = []
    if auto or isinstance(o, SegmentOptions):
        so = o if isinstance(o, SegmentOptions) else SegmentOptions()
        seeds = None
        if so.curvature_seeding and len(t):
            from tessera.operators.curvature import vertex_curvatures

            remap, first = weld(p, so.weld_tolerance)
            k = np.abs(vertex_curvatures(p[first], remap[t])[:, :2]).max(1)
            seeds = np.argsort(k[remap[t]].mean(1), kind="stable")
        out.append(("dihedral", *segment(p, t, so, seeds)))
    # no way covers more than everything, and a tie is the first one's
    if not out or auto and coverage(p, t, out[0][1], out[0][2]) < 1 - 1e-12:
        out.append(("ransac", *ransac(p, t, o if isinstance(o, RansacOptions) else RansacOptions()), False))
    return out


def segmented(mesh: Mesh, options: SegmentOptions | RansacOptions | None = None, auto: bool = False) -> DataFrame:
    """One row per region. With ``auto`` both ways are run and the one with the better coverage is kept (smooth growing on a tie)."""
    o = options or SegmentOptions()

    def run(mesh_id, p, t, ids):
        name, regions, fits, out, skipped = max(ways(p, t, o, auto), key=lambda w: coverage(p, t, w[1], w[2]))
        a = 0.5 * np.linalg.norm(cross(p, t), axis=1)
        score = coverage(p, t, regions, fits)
        rows = [(mesh_id, name, i, r, len(r), float(a[r].sum()), f.kind, list(f.params), f.rms, f.most, f.inliers, out, skipped, score) for i, (r, f) in enumerate(zip(regions, fits))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REGIONS.split(", ")])

    return per_mesh(mesh, run, REGIONS)
