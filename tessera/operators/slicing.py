"""Planar slices: straddling triangles give segments by expressions; segments of one slice are chained in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.model import Mesh, bounds, corners


@dataclass(frozen=True)
class CutPlane:
    point: tuple[float, float, float]
    normal: tuple[float, float, float]

    @staticmethod
    def perpendicular(axis: tuple[float, float, float], offset: float) -> CutPlane:
        n = math.sqrt(sum(c * c for c in axis))
        if n == 0:
            raise ValueError("the axis has no length")
        unit = tuple(c / n for c in axis)
        return CutPlane(tuple(c * offset for c in unit), unit)

    def basis(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit normal, u and v of the plane; u comes from the axis that the normal has least of."""
        n = np.array(self.normal, float)
        n = n / np.linalg.norm(n)
        a = np.abs(n)
        seed = np.eye(3)[0 if a[0] <= a[1] and a[0] <= a[2] else 1 if a[1] <= a[2] else 2]
        u = np.cross(n, seed)
        u /= np.linalg.norm(u)
        return n, u, np.cross(n, u)


def stack_planes(mesh: Mesh, axis: tuple[float, float, float], spacing: float, through: tuple[float, float, float] = (0.0, 0.0, 0.0), margin: float | None = None) -> DataFrame:
    """mesh_id, plane_id, offset, ox..oz, nx..nz: planes across the axis, ``spacing`` apart, from ``margin`` (half the spacing) above the
    mesh's lowest point to as much below its highest; offsets are measured from ``through``. No planes if the spacing isn't positive."""
    n = CutPlane.perpendicular(axis, 0).normal
    margin = spacing / 2 if margin is None else margin
    d = sum(((F.col(c).cast("double") - float(o)) * float(k) for c, o, k in zip("xyz", through, n)), F.lit(0.0))
    ends = mesh.vertices.groupBy("mesh_id").agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    if spacing <= 0:
        ends = ends.where("false")
    room = (F.col("hi") - F.col("lo") - 2 * margin) / float(spacing or 1)
    ids = ends.where(room >= -1e-9).select("mesh_id", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(room + 1e-9).cast("long"))).alias("plane_id"))
    at = F.col("lo") + margin + F.col("plane_id") * float(spacing)
    place = [(F.lit(float(o)) + at * float(k)).alias("o" + c) for c, o, k in zip("xyz", through, n)]
    return ids.select("mesh_id", F.col("plane_id").cast("int").alias("plane_id"), at.alias("offset"), *place, *(F.lit(float(k)).alias("n" + c) for c, k in zip("xyz", n)))


def stacked_sections(
    mesh: Mesh, axis: tuple[float, float, float], spacing: float, through: tuple[float, float, float] = (0.0, 0.0, 0.0), margin: float | None = None, min_loop_area: float = 0.0, weld: float = 0.0
) -> DataFrame:
    """The contours of every mesh with its own stack of planes, and each plane's offset. A triangle meets only the planes between its ends."""
    planes = stack_planes(mesh, axis, spacing, through, margin)
    first = planes.where("plane_id = 0").select("mesh_id", F.col("offset").alias("start"))
    count = planes.groupBy("mesh_id").agg(F.max("plane_id").alias("last"))
    n = CutPlane.perpendicular(axis, 0).normal
    c = corners(mesh).join(first.hint("merge"), "mesh_id").join(count.hint("merge"), "mesh_id")
    d = [sum(((F.col(k + x).cast("double") - float(o)) * float(m) for x, o, m in zip("xyz", through, n)), F.lit(0.0)) for k in "abc"]
    low, high = ((f(*d) - F.col("start")) / float(spacing or 1) for f in (F.least, F.greatest))
    # one plane more on either side: the float distances below decide
    c = c.withColumn("k0", F.greatest(F.lit(0), F.ceil(low) - 1).cast("long")).withColumn("k1", F.least(F.col("last").cast("long"), F.floor(high) + 1)).where("k0 <= k1")
    at = F.col("start") + F.col("plane_id") * float(spacing)
    place = [(F.lit(float(o)) + at * float(k)).alias("o" + x) for x, o, k in zip("xyz", through, n)]
    cut = c.withColumn("plane_id", F.explode(F.sequence("k0", "k1"))).withColumn("plane_id", F.col("plane_id").cast("int")).drop("k0", "k1", "last")
    cut = cut.select("*", *place, *(F.lit(float(k)).alias("n" + x) for x, k in zip("xyz", n)))
    flat = CutPlane.perpendicular(axis, 0).basis()
    out = _contours(mesh, _crossed(cut), lambda _: (None, *flat), min_loop_area, weld, through)
    return out.join(planes.select("mesh_id", "plane_id", "offset").hint("merge"), ["mesh_id", "plane_id"])


def segments(mesh: Mesh, planes: list[CutPlane]) -> DataFrame:
    """mesh_id, plane_id, tid, px..pz, qx..qz: where each triangle crosses each plane of a short list. Points on the plane count as above."""
    usable = [(i, p) for i, p in enumerate(planes) if any(p.normal)]
    rows = []
    for i, p in usable:
        n, _, _ = p.basis()
        rows.append(F.struct(F.lit(i).alias("plane_id"), *(F.lit(float(v)).alias(k) for k, v in zip(("ox", "oy", "oz", "nx", "ny", "nz"), (*p.point, *n)))))
    c = corners(mesh)
    return _crossed(c.select("*", F.inline(F.array(*rows))) if rows else c.select("*", *(F.lit(None).cast("double").alias(k) for k in ("plane_id", "ox", "oy", "oz", "nx", "ny", "nz"))).where("false"))


def _crossed(cut: DataFrame) -> DataFrame:
    """The segments of triangles (corners) and planes (plane_id, ox..oz, nx..nz)."""
    n, o = V.vec("n"), V.vec("o")
    for k in "abc":
        cut = cut.withColumn("d" + k, V.dot(V.sub(V.vec(k), o), n).cast("float"))
    cut = cut.where("NOT ((da >= 0) = (db >= 0) AND (db >= 0) = (dc >= 0))")

    def crossing(a: str, b: str):
        t = (F.col("d" + a) / (F.col("d" + a) - F.col("d" + b))).cast("double")
        return F.when((F.col("d" + a) >= 0) != (F.col("d" + b) >= 0), F.struct(*((F.col(a + c).cast("double") + t * (F.col(b + c).cast("double") - F.col(a + c))).alias(c) for c in "xyz")))

    ends = F.filter(F.array(crossing("a", "b"), crossing("b", "c"), crossing("c", "a")), lambda x: x.isNotNull())
    cut = cut.withColumn("ends", ends)
    return cut.select("mesh_id", "plane_id", "tid", *(F.col("ends")[i][c].alias(p + c) for i, p in ((0, "p"), (1, "q")) for c in "xyz"))


def chain(points: np.ndarray, cell: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Closed loops and open paths (arrays of points) of segments [n, 2, 3] whose ends merge by cell."""
    key = np.floor(np.abs(points) / cell + 0.5) * np.sign(points)
    ids: dict[tuple, int] = {}
    where: list[np.ndarray] = []
    near: list[list[int]] = []
    for seg, k in zip(points, key):
        pair = []
        for p, q in zip(seg, k):
            t = tuple(q + 0.0)
            if t not in ids:
                ids[t] = len(where)
                where.append(p)
                near.append([])
            pair.append(ids[t])
        if pair[0] != pair[1]:
            near[pair[0]].append(pair[1])
            near[pair[1]].append(pair[0])
    used: set[tuple[int, int]] = set()
    loops, paths = [], []
    starts = [i for i in range(len(where)) if len(near[i]) == 1] + [i for i in range(len(where)) if len(near[i]) != 1]
    for s in starts:
        while True:
            walk, at, closed = [s], s, False
            while True:
                nxt = next((x for x in near[at] if (min(at, x), max(at, x)) not in used), None)
                if nxt is None:
                    break
                used.add((min(at, nxt), max(at, nxt)))
                if nxt == s:
                    closed = len(walk) >= 3
                    break
                walk.append(nxt)
                at = nxt
            if len(walk) < 2:
                break
            (loops if closed else paths).append(np.array([where[i] for i in walk]))
            if not closed and at == s:
                break
    return loops, paths


def _inside(p: np.ndarray, ring: np.ndarray) -> bool:
    x, y = ring[:, 0], ring[:, 1]
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    hit = (y > p[1]) != (y2 > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x2 - x) * (p[1] - y) / (y2 - y) + x
    return bool((hit & (p[0] < at)).sum() % 2)


CONTOURS = "mesh_id long, plane_id int, contour_id int, closed boolean, depth int, parent int, is_hole boolean, signed_area double, perimeter double, us array<double>, vs array<double>"


def cross_sections(mesh: Mesh, planes: list[CutPlane], min_loop_area: float = 0.0, weld: float = 0.0) -> DataFrame:
    """Contours of every mesh and plane: closed loops with nesting (outer ones counter-clockwise, holes clockwise), and open paths."""
    flat = [(p.point, *p.basis()) for p in planes]
    return _contours(mesh, segments(mesh, planes), flat.__getitem__, min_loop_area, weld)


def _contours(mesh: Mesh, found: DataFrame, of, min_loop_area: float, weld: float, origin=None) -> DataFrame:
    """Contours of segments; ``of(plane_id)`` gives a plane's origin, normal and axes (origin None: the same for all)."""
    box = bounds(mesh.vertices).select("mesh_id", "diag")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        o, _, u, v = of(key[1])
        o = origin if o is None else o
        pdf = pdf.sort_values("tid")
        seg = pdf[["px", "py", "pz", "qx", "qy", "qz"]].to_numpy().reshape(-1, 2, 3)
        loops, paths = chain(seg, weld if weld > 0 else max(1e-9, 1e-6 * float(pdf["diag"].iloc[0])))
        rings = [np.stack(((x - o) @ u, (x - o) @ v), 1) for x in loops]
        area = [0.5 * float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum()) for r in rings]
        kept = [(r, a) for r, a in zip(rings, area) if abs(a) >= min_loop_area]
        out = []
        for i, (r, a) in enumerate(kept):
            around = [j for j, (x, _) in enumerate(kept) if j != i and _inside(r[0], x)]
            hole = len(around) % 2 == 1
            if (a < 0) != hole:
                r, a = r[::-1], -a
            length = float(np.linalg.norm(r - np.roll(r, -1, 0), axis=1).sum())
            parent = min(around, key=lambda j: abs(kept[j][1])) if around else None
            out.append((*key, i, True, len(around), parent, hole, a, length, r[:, 0].tolist(), r[:, 1].tolist()))
        for k, x in enumerate(paths):
            r = np.stack(((x - o) @ u, (x - o) @ v), 1)
            out.append((*key, len(kept) + k, False, None, None, None, None, float(np.linalg.norm(np.diff(r, axis=0), axis=1).sum()), r[:, 0].tolist(), r[:, 1].tolist()))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in CONTOURS.split(", ")])
        return frame.astype({"depth": "Int32", "parent": "Int32"})

    return found.join(box.hint("merge"), "mesh_id").groupBy("mesh_id", "plane_id").applyInPandas(run, CONTOURS)


def world_point(plane: CutPlane, u: float, v: float) -> tuple[float, float, float]:
    _, a, b = plane.basis()
    return tuple(float(x) for x in np.array(plane.point) + u * a + v * b)
