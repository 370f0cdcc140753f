"""What renderers ask of index buffers: triangle strips, provoking vertices, orders for vertex caches, and bounds of clusters."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import Mesh
from tessera.operators.permesh import cross, per_mesh

STRIPS = "mesh_id long, strip_id long, pos long, vid long"
PROVOKING = "mesh_id long, tid long, i0 long, i1 long, i2 long, v0 long, v1 long, v2 long"
ORDER = "mesh_id long, tid long, place long"
BOUNDS = "mesh_id long, meshlet_id long, x double, y double, z double, radius double, apex_x double, apex_y double, apex_z double, axis_x double, axis_y double, axis_z double, cutoff double, s8_x int, s8_y int, s8_z int, s8_cutoff int"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def strips(mesh: Mesh) -> DataFrame:
    """mesh_id, strip_id, pos, vid: each triangle in one strip; two places on, every vertex makes a triangle with the two before it, turned at
    odd places. A strip starts at the first triangle left and goes on across its last edge while a triangle with that edge is left.
    One mesh is one task, as each strip depends on those before it. Triangles with a corner twice come as strips of their own."""

    def run(mesh_id, p, t, ids):
        across: dict[tuple[int, int], deque[int]] = {}
        for f, (a, b, c) in enumerate(t.tolist()):
            for e in ((a, b), (b, c), (c, a)):
                across.setdefault(e, deque()).append(f)
        used, rows, number = np.zeros(len(t), bool), [], 0

        def left(edge: tuple[int, int]) -> int | None:
            q = across.get(edge)
            while q and used[q[0]]:
                q.popleft()
            return q[0] if q else None

        for f, corner in enumerate(t.tolist()):
            if used[f]:
                continue
            used[f] = True
            turn = next((k for k in range(3) if left((corner[(k + 2) % 3], corner[(k + 1) % 3])) is not None), 0)
            strip = corner[turn:] + corner[:turn]
            while len(set(corner)) == 3:
                # the next triangle runs along the last edge the other way: after an even number of vertices, as it stands
                edge = (strip[-1], strip[-2]) if len(strip) % 2 else (strip[-2], strip[-1])
                f = left(edge)
                if f is None or len(set(t[f].tolist())) < 3:
                    break
                used[f] = True
                strip.append(next(v for v in t[f].tolist() if v not in edge))
            rows += [(mesh_id, number, k, int(ids[v])) for k, v in enumerate(strip)]
            number += 1
        return pd.DataFrame(rows, columns=_names(STRIPS))

    return per_mesh(mesh, run, STRIPS)


def unstripped(strip: DataFrame) -> DataFrame:
    """mesh_id, strip_id, pos, i0, i1, i2 of strips(): its triangles, but for those with a corner twice. A window over each strip."""
    w = Window.partitionBy("mesh_id", "strip_id").orderBy("pos")
    s = strip.select("*", F.lag("vid", 2).over(w).alias("p"), F.lag("vid", 1).over(w).alias("q"), (F.row_number().over(w) % 2 == 0).alias("odd")).where("p IS NOT NULL AND p <> q AND q <> vid AND p <> vid")
    return s.select("mesh_id", "strip_id", "pos", F.when(F.col("odd"), F.col("q")).otherwise(F.col("p")).alias("i0"), F.when(F.col("odd"), F.col("p")).otherwise(F.col("q")).alias("i1"), F.col("vid").alias("i2"))


def provoking_indices(mesh: Mesh) -> DataFrame:
    """mesh_id, tid, i0..i2 (new indices), v0..v2 (the vertices they stand for): triangles turned so that the first index of the n-th is n.
    A triangle gives its first index to a corner not given yet, the one in the fewest triangles; if all are, the first is doubled. Corners that
    no triangle gave its index to are numbered behind them. One mesh is one task."""

    def run(mesh_id, p, t, ids):
        uses, given, turned = np.bincount(t.reshape(-1), minlength=len(p)), {}, []
        for n, row in enumerate(t.tolist()):
            k = min(range(3), key=lambda k: (row[k] in given, 0 if row[k] in given else uses[row[k]], k))
            turned.append(row[k:] + row[:k])
            given.setdefault(row[k], n)
        rest = len(t)
        rows = []
        for n, row in enumerate(turned):
            for v in row[1:]:
                if v not in given:
                    given[v], rest = rest, rest + 1
            rows.append((mesh_id, n, n, given[row[1]], given[row[2]], *(int(ids[v]) for v in row)))
        return pd.DataFrame(rows, columns=_names(PROVOKING))

    return per_mesh(mesh, run, PROVOKING)


def cache_order(mesh: Mesh, cache: int = 16) -> DataFrame:
    """mesh_id, tid, place: an order of triangles that a first-in first-out cache of so many vertices serves well. All triangles about a vertex
    follow each other; the next vertex is the oldest of their corners that will still be held when its own triangles are done, or else the last
    one seen with triangles left (Sander, Nehab and Barczak, 2007). One mesh is one task; tid of the result counts triangles in order of tid."""
    if cache < 3:
        raise ValueError("the cache holds a triangle at least")

    def run(mesh_id, p, t, ids):
        rows = t.tolist()
        about: list[list[int]] = [[] for _ in range(len(p))]
        for f, row in enumerate(rows):
            for v in set(row):
                about[v].append(f)
        left, since, clock = [len(a) for a in about], [-cache - 1] * len(p), 0
        done, out, dead, fresh, fan = [False] * len(rows), [], [], 0, 0 if len(p) else None
        while fan is not None:
            near = []
            for f in about[fan]:
                if done[f]:
                    continue
                done[f] = True
                out.append(f)
                for v in dict.fromkeys(rows[f]):
                    dead.append(v)
                    near.append(v)
                    left[v] -= 1
                    if clock - since[v] > cache:
                        clock += 1
                        since[v] = clock
            fan, best = None, -1
            for v in near:
                if left[v]:
                    age = clock - since[v]
                    worth = age if age + 2 * left[v] <= cache else 0
                    if worth > best:
                        fan, best = v, worth
            while fan is None and dead:
                v = dead.pop()
                fan = v if left[v] else None
            while fan is None and fresh < len(p):
                fan = fresh if left[fresh] else None
                fresh += 1
        return pd.DataFrame({"mesh_id": mesh_id, "tid": out, "place": range(len(out))}, columns=_names(ORDER))

    return per_mesh(mesh, run, ORDER)


#: The axes and the diagonals of a cube.
DIRECTIONS = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1], [-1, 1, 1], [1, -1, 1], [1, 1, -1]], float)


def sphere(p: np.ndarray, radii: np.ndarray, directions: np.ndarray = DIRECTIONS) -> tuple[np.ndarray, float]:
    """(centre, radius) of a sphere around spheres: that of the two farthest apart of the extremes, grown to hold the rest (Ritter, 1990)."""
    along, reach = p @ directions.T, radii[:, None] * np.linalg.norm(directions, axis=1)
    lo, hi = (along - reach).argmin(0), (along + reach).argmax(0)
    k = int((np.linalg.norm(p[hi] - p[lo], axis=1) + radii[lo] + radii[hi]).argmax())
    centre, radius = p[lo[k]].copy(), float(radii[lo[k]])
    for i in (hi[k], *range(len(p))):
        gap = p[i] - centre
        far = float(np.sqrt(gap @ gap))
        if far + radii[i] <= radius:
            continue
        if far + radius <= radii[i]:
            centre, radius = p[i].copy(), float(radii[i])
            continue
        grown = (far + radius + radii[i]) / 2
        centre, radius = centre + gap * ((grown - radius) / far), float(grown)
    return centre, radius


def sphere_bounds(spheres: DataFrame, key: str = "mesh_id") -> DataFrame:
    """key, x, y, z, radius around the rows (key, x, y, z, radius) of each key; a null radius is 0, rows without a place are left out.
    The rows of one key are one task: a cluster's."""

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["x", "y", "z"])
        if not len(rows):
            return pd.DataFrame(columns=[key, "x", "y", "z", "radius"])
        c, r = sphere(rows[["x", "y", "z"]].to_numpy(float), rows["radius"].fillna(0).to_numpy(float))
        return pd.DataFrame([(k[0], *map(float, c), r)], columns=[key, "x", "y", "z", "radius"])

    return spheres.select(key, *(F.col(c).cast("double") for c in ("x", "y", "z", "radius"))).groupBy(key).applyInPandas(run, f"{key} {dict(spheres.dtypes)[key]}, x double, y double, z double, radius double")


def cluster_bounds(corners: DataFrame) -> DataFrame:
    """For each (mesh_id, meshlet_id) of rows with ax .. cz: a sphere around its corners and a cone that holds its triangles' normals:
    axis, cutoff (the sine of half its angle) and apex, behind all triangles. Flat triangles count for nothing, and clusters of none but those are all 0.
    Where the cone would be over 168 degrees wide it is of no use: cutoff 1, axis and apex 0. The s8 columns hold axis and cutoff in 8 bits, so that the
    cutoff errs on the safe side. A cluster, small by definition, is one task."""

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[[q + c for q in "abc" for c in "xyz"]].to_numpy(float).reshape(-1, 3)
        t = np.arange(len(p)).reshape(-1, 3)
        raw = cross(p, t)
        size = np.linalg.norm(raw, axis=1)
        n, first = raw[size > 0] / size[size > 0][:, None], p[t[size > 0][:, 0]]
        row = [0.0] * 11 + [0] * 4
        if len(n):
            flat = np.unique(p, axis=0)
            centre, radius = sphere(flat, np.zeros(len(flat)))
            middle, _ = sphere(n, np.zeros(len(n)), DIRECTIONS[:3])
            long = float(np.sqrt(middle @ middle))
            axis = middle / long if long > 0 else middle
            least = min(1.0, float((n @ axis).min()))
            row[:4] = [*map(float, centre), radius]
            if least <= 0.1:
                row[10], row[14] = 1.0, 127
            else:
                back = max(0.0, float((((centre - first) * n).sum(1) / (n @ axis)).max()))
                cutoff = float(np.sqrt(max(0.0, 1 - least * least)))
                short = np.sign(axis) * np.floor(np.abs(axis) * 127 + 0.5)
                safe = min(127, int(127 * (cutoff + float(np.abs(short / 127 - axis).sum())) + 1))
                row[4:] = [*map(float, centre - axis * back), *map(float, axis), cutoff, *map(int, short), safe]
        return pd.DataFrame([(*map(int, k), *row)], columns=_names(BOUNDS))

    return corners.select("mesh_id", "meshlet_id", *(q + c for q in "abc" for c in "xyz")).groupBy("mesh_id", "meshlet_id").applyInPandas(run, BOUNDS)
