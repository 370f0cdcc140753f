"""Queries over meshes of known shape, whose answers SQL computes from the shapes' measures, not from the meshes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.model import Mesh, corners
from tessera.operators import alignment, curvature, decimation, foundations, rendering, segmentation, slicing, winding
from tessera.sources import lathes
from tessera.sources.lathes import AROUND, RINGS

LEVEL = 1.3
#: The motion that the alignment query undoes: a turn about this vector, and a shift.
TURN, SHIFT = (0.04, -0.03, 0.08), (0.6, -0.4, 0.3)


def _regions(m: Mesh, options, auto: bool = False, *more: str) -> DataFrame:
    r = segmentation.segmented(m, options, auto)
    radius = F.when(F.col("kind") == "cylinder", F.col("params")[6]).when(F.col("kind") == "sphere", F.col("params")[3])
    return r.select("mesh_id", "region_id", "n_tri", F.round("area", 2).alias("area"), F.col("kind").alias("shape"), F.round(radius, 3).alias("radius"), "left_out", *more)


def _aligned(m: Mesh) -> DataFrame:
    """Globes with a bump, moved and found again: the twelve numbers of the motion back."""
    bump = "CASE WHEN vid IN (77, 78, 101, 102, 103, 54) THEN 1.25D WHEN vid IN (40, 15, 130) THEN 0.8D ELSE 1D END"
    v = m.vertices.selectExpr("mesh_id", "vid", *(f"{k} * {bump} AS {c}" for c, k in (("x", "x * 1.6D"), ("y", "y * 1.2D"), ("z", "z * 0.9D"))))
    rot = alignment.rodrigues(np.array(TURN))
    turned = v.selectExpr("mesh_id", "vid", *(f"cast({float(a)!r}D * x + {float(b)!r}D * y + {float(c)!r}D * z + {t!r}D AS float) AS {k}" for (a, b, c), t, k in zip(rot, SHIFT, "xyz")))
    fixed = v.selectExpr("mesh_id", "vid", *(f"cast({k} AS float) AS {k}" for k in "xyz"))
    pairs = v.select("mesh_id").distinct().selectExpr("mesh_id AS pair_id", "mesh_id AS source_mesh_id", "mesh_id AS reference_mesh_id")
    out = alignment.aligned(Mesh(turned, m.triangles), Mesh(fixed, m.triangles), pairs)
    return out.select("pair_id", *(F.round(F.col("transform")[4 * c + r], 2).alias(f"m{r}{c}") for r in range(3) for c in range(4)), "converged")


def _simplified(m: Mesh) -> DataFrame:
    out = decimation.simplified(m, decimation.SimplifyOptions(target_reduction=0.5))
    corner = lambda k: [F.col("vertices")[F.col("t")[k]][c] for c in range(3)]
    t = out.select("mesh_id", "before", "after", "error", "vertices", F.explode("triangles").alias("t"))
    a, b, c = corner(0), corner(1), corner(2)
    area = V.norm(V.cross(V.sub(b, a), V.sub(c, a))) / 2
    return t.groupBy("mesh_id", "before", "after", F.round("error", 3).alias("error")).agg(F.round(F.sum(area), 2).alias("area"))


def _clusters(m: Mesh) -> DataFrame:
    """Bounds of the quarters of tubes."""
    quarter = F.expr(f"((tid div 2) % {AROUND}) div {AROUND // 4}")
    out = rendering.cluster_bounds(corners(m).withColumn("meshlet_id", quarter))
    return out.select(*((F.round(c, 3) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


def _checkered(m: Mesh) -> DataFrame:
    """Every other quadrangle is gone: the inner points hold two corners that share no edge."""
    q = "(tid div 2)"
    kept = m.triangles.where(f"({q} div {AROUND} + {q} % {AROUND}) % 2 = 0")
    return foundations.nonmanifold_vertices(kept)


def _orientation(m: Mesh) -> DataFrame:
    flip = (F.col("mesh_id") % 3) == 0
    t = m.triangles.select("mesh_id", "tid", "i0", F.when(flip, F.col("i2")).otherwise(F.col("i1")).alias("i1"), F.when(flip, F.col("i1")).otherwise(F.col("i2")).alias("i2"))
    return winding.orientation_report(Mesh(m.vertices, t)).select("mesh_id", "looks_inverted")


def _loops(m: Mesh) -> DataFrame:
    return foundations.boundary_loops(m).select("mesh_id", "loop_id", F.size("vertices").cast("long").alias("n"), F.array_min("vertices").alias("least"), F.array_max("vertices").alias("greatest"))


def _sections(m: Mesh) -> DataFrame:
    out = slicing.cross_sections(m, [slicing.CutPlane((0.0, 0.0, LEVEL), (0.0, 0.0, 1.0))])
    return out.select("mesh_id", "closed", "is_hole", "depth", F.round("signed_area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"))


def _stack(m: Mesh) -> DataFrame:
    out = slicing.stacked_sections(m, (0.0, 0.0, 2.0), 1.5, (0.0, 0.0, 1.0))
    return out.select("mesh_id", F.col("plane_id").cast("long").alias("plane_id"), F.round("offset", 4).alias("offset"), "closed", F.round("perimeter", 3).alias("perimeter"))


def _curvature(m: Mesh) -> DataFrame:
    inner = curvature.curvatures(m).where(f"vid >= {AROUND} AND vid < {AROUND * (RINGS - 1)}")
    return inner.select("mesh_id", "vid", *((F.round(k, 3) + 0.0).alias(k) for k in ("k1", "k2", "mean", "gaussian")))


def _slippage(m: Mesh) -> DataFrame:
    return curvature.slippages(m).select("mesh_id", F.col("kind").alias("shape"), F.round(F.abs(F.col("axis_direction")[2]), 3).alias("along_z"))


def _creases(m: Mesh) -> DataFrame:
    return curvature.crease_edges(m, 40.0).select("mesh_id", "lo", "hi", F.round("angle", 2).alias("angle"))


def _rings(m: Mesh) -> DataFrame:
    out = curvature.crease_rings(m, 40.0)
    return out.select("mesh_id", F.col("ring_id").cast("long").alias("ring_id"), "closed", F.size("vertices").cast("long").alias("n"), F.round("length", 3).alias("length"), F.round("mean_angle", 2).alias("mean_angle"))


ALL: dict[str, Callable[[Mesh], DataFrame]] = {
    "mesh_segmented": lambda m: _regions(m, segmentation.SegmentOptions()),
    "mesh_segmented_auto": lambda m: _regions(m, segmentation.SegmentOptions(), True, "strategy", "score"),
    "mesh_boundary_loops": _loops,
    "mesh_nonmanifold_vertices": _checkered,
    "mesh_orientation": _orientation,
    "mesh_cross_sections": _sections,
    "mesh_crease_edges": _creases,
    "mesh_crease_rings": _rings,
}
SOME: dict[str, tuple[tuple[int, ...], Callable[[Mesh], DataFrame]]] = {
    "mesh_segmented_ransac": ((0, 1), lambda m: _regions(m, segmentation.RansacOptions(min_support=60))),
    "mesh_aligned": ((2,), _aligned),
    "mesh_simplified": ((0, 1, 3), _simplified),
    "mesh_cluster_bounds": ((0,), _clusters),
    "mesh_section_stack": ((0, 1, 3), _stack),
    "mesh_curvature": ((0,), _curvature),
    "mesh_slippage": ((0, 1, 2), _slippage),
}


def _query(run: Callable[[Mesh], DataFrame], kinds: tuple[int, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        of = lathes.shapes(spark, sf_dir)
        if kinds:
            of = of.where(F.col("kind").isin(*kinds))
        return run(lathes.lathes(of))

    return query


QUERIES = {name: _query(run) for name, run in ALL.items()} | {name: _query(run, kinds) for name, (kinds, run) in SOME.items()}

_N = f"(2 * sin(pi() / {AROUND}))"
_C = f"cos(pi() / {AROUND})"
#: Ring radius and height at a share u of the way, and areas, from the measures alone.
_BASE = f"""WITH {lathes.SHAPES_SQL},
RG AS (SELECT S.*, i, CASE kind WHEN 1 THEN r * (1 - i / {RINGS - 1}.0 / 2) WHEN 2 THEN r * cos(radians(120 * i / {RINGS - 1}.0 - 60)) ELSE r END AS rho,
       CASE kind WHEN 2 THEN r * sin(radians(120 * i / {RINGS - 1}.0 - 60)) ELSE h * i / {RINGS - 1}.0 END AS z FROM S, (SELECT unnest(range({RINGS})) AS i)),
BANDS AS (SELECT *, lead(rho) OVER w AS rho1, lead(z) OVER w AS z1 FROM RG WINDOW w AS (PARTITION BY mesh_id ORDER BY i)),
AR AS (SELECT mesh_id, any_value(kind) AS kind, any_value(r) AS r, any_value(h) AS h,
       CASE WHEN any_value(kind) = 3 THEN 6 * any_value(r) * any_value(h) ELSE sum({AROUND} * {_N} * (rho + rho1) / 2 * sqrt((z1 - z) ** 2 + ((rho1 - rho) * {_C}) ** 2)) END AS area FROM BANDS WHERE rho1 IS NOT NULL GROUP BY 1),
"""
_REGIONS = """REG AS (
  SELECT mesh_id, 0::BIGINT AS region_id, 288::BIGINT AS n_tri, round(area, 2) AS area, ['cylinder', 'cone', 'sphere'][kind + 1] AS shape, CASE WHEN kind <> 1 THEN r END AS radius, 0::BIGINT AS left_out FROM AR WHERE kind < 3
  UNION ALL SELECT mesh_id, k, 48, round(area / 6, 2), 'plane', NULL, 0 FROM AR, (SELECT unnest(range(6)) AS k) WHERE kind = 3)
"""
_POLYGON = f"CASE WHEN kind = 3 THEN 6 * rho ELSE {AROUND} * {_N} * rho END"


def _motion_back() -> list[list[float]]:
    """The inverse of the motion, from the turn's matrix: its transpose, and the shift turned back."""
    r = alignment.rodrigues(np.array(TURN)).T
    return [[*map(float, row), -float(row @ SHIFT)] for row in r]


SQL = {
    "mesh_segmented": _BASE + _REGIONS + "SELECT * FROM REG",
    "mesh_segmented_auto": _BASE + _REGIONS + "SELECT *, 'dihedral' AS strategy, 1.0::DOUBLE AS score FROM REG",
    "mesh_segmented_ransac": _BASE + _REGIONS + "SELECT REG.* FROM REG JOIN S USING (mesh_id) WHERE kind < 2",
    "mesh_aligned": f"WITH {lathes.SHAPES_SQL} SELECT mesh_id AS pair_id, " + ", ".join(f"round({v!r}::DOUBLE, 2) + 0.0 AS m{r}{c}" for r, row in enumerate(_motion_back()) for c, v in enumerate(row)) + ", true AS converged FROM S WHERE kind = 2",
    "mesh_simplified": _BASE.rstrip(",\n") + " SELECT mesh_id, 288::BIGINT AS before, 144::BIGINT AS after, 0.0::DOUBLE AS error, round(area, 2) AS area FROM AR WHERE kind <> 2",
    "mesh_cluster_bounds": f"WITH {lathes.SHAPES_SQL}, Q AS (SELECT *, cos(radians(90 * k + 45)) AS c, sin(radians(90 * k + 45)) AS s FROM S, (SELECT unnest(range(4)) AS k) WHERE kind = 0) SELECT mesh_id, k AS meshlet_id, "
    + ", ".join(f"round({v}, 3) + 0.0 AS {n}" for n, v in (("x", "r * c / sqrt(2)"), ("y", "r * s / sqrt(2)"), ("z", "h / 2"), ("radius", "sqrt(2 * r * r + h * h) / 2"), ("apex_x", "r * c / sqrt(2)"), ("apex_y", "r * s / sqrt(2)"), ("apex_z", "h / 2"), ("axis_x", "c"), ("axis_y", "s"), ("axis_z", "0.0::DOUBLE"), ("cutoff", "sin(radians(37.5))")))
    + ", (sign(c) * 90)::INT AS s8_x, (sign(s) * 90)::INT AS s8_y, 0 AS s8_z, floor(127 * (sin(radians(37.5)) + 2 * abs(90 / 127 - sqrt(0.5))) + 1)::INT AS s8_cutoff FROM Q",
    "mesh_boundary_loops": f"WITH {lathes.SHAPES_SQL} SELECT mesh_id, k AS loop_id, {AROUND}::BIGINT AS n, {AROUND * (RINGS - 1)} * k AS least, {AROUND * (RINGS - 1)} * k + {AROUND - 1} AS greatest FROM S, (SELECT unnest([0, 1])::BIGINT AS k)",
    "mesh_nonmanifold_vertices": f"WITH {lathes.SHAPES_SQL} SELECT mesh_id, vid FROM S, (SELECT unnest(range({AROUND}, {AROUND * (RINGS - 1)})) AS vid)",
    "mesh_orientation": f"WITH {lathes.SHAPES_SQL} SELECT mesh_id, mesh_id % 3 = 0 AS looks_inverted FROM S",
    "mesh_cross_sections": _BASE
    + f"CUT AS (SELECT mesh_id, kind, rho + (rho1 - rho) * ({LEVEL} - z) / (z1 - z) AS rho FROM BANDS WHERE z <= {LEVEL} AND {LEVEL} < z1) "
    + f"SELECT mesh_id, true AS closed, false AS is_hole, 0 AS depth, round(CASE WHEN kind = 3 THEN 1.5 * sqrt(3) * rho * rho ELSE {AROUND} / 2.0 * rho * rho * sin(2 * pi() / {AROUND}) END, 3) AS area, round({_POLYGON}, 3) AS perimeter FROM CUT",
    "mesh_section_stack": _BASE.rstrip(",\n")
    + f" SELECT mesh_id, k AS plane_id, round(-1 + 0.75 + 1.5 * k, 4)::DOUBLE AS \"offset\", true AS closed, round({_POLYGON.replace('rho', '(CASE WHEN kind = 1 THEN r * (1 - (0.75 + 1.5 * k) / h / 2) ELSE r END)')}, 3) AS perimeter FROM AR, (SELECT unnest(range(20)) AS k) WHERE kind <> 2 AND 0.75 + 1.5 * k <= h - 0.75",
    "mesh_curvature": f"WITH {lathes.SHAPES_SQL} SELECT mesh_id, vid, round(1 / r, 3) AS k1, 0.0::DOUBLE AS k2, round(1 / r / 2, 3) AS mean, 0.0::DOUBLE AS gaussian FROM S, (SELECT unnest(range({AROUND}, {AROUND * (RINGS - 1)})) AS vid) WHERE kind = 0",
    "mesh_slippage": f"WITH {lathes.SHAPES_SQL} SELECT mesh_id, ['cylinder', 'revolution', 'sphere'][kind + 1] AS shape, CASE WHEN kind < 2 THEN 1.0::DOUBLE END AS along_z FROM S WHERE kind < 3",
    "mesh_crease_edges": f"WITH {lathes.SHAPES_SQL} SELECT mesh_id, {AROUND} * i + 4 * c AS lo, {AROUND} * (i + 1) + 4 * c AS hi, 60.0::DOUBLE AS angle FROM S, (SELECT unnest(range({RINGS - 1})) AS i), (SELECT unnest(range(6)) AS c) WHERE kind = 3",
    "mesh_crease_rings": f"WITH {lathes.SHAPES_SQL} SELECT mesh_id, c AS ring_id, false AS closed, {RINGS}::BIGINT AS n, h::DOUBLE AS length, 60.0::DOUBLE AS mean_angle FROM S, (SELECT unnest(range(6)) AS c) WHERE kind = 3",
}
