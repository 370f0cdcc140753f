"""Winding numbers and orientation reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.model import Mesh, bounds, corners, edges

#: Parts that a mesh's triangles are dealt to, so that one large mesh is not one task; its points go to each.
PARTS = 32


def winding_number(mesh: Mesh, points: DataFrame) -> DataFrame:
    """mesh_id, point_id, winding of points(mesh_id, point_id, px, py, pz): the sum of solid angles over 4 pi.

    Each triangle meets the points of its own mesh: an equi-join on mesh_id and one of PARTS parts of the mesh; sums are reduced
    before the shuffle.
    """
    dealt = points.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    seen = corners(mesh).withColumn("part", F.pmod("tid", F.lit(PARTS)).cast("int")).join(dealt.hint("merge"), ["mesh_id", "part"])
    return seen.groupBy("mesh_id", "point_id").agg((F.sum(V.solid_angle(V.vec("p"))) / (4 * math.pi)).alias("winding"))


def orientation_report(mesh: Mesh, samples: int = 64) -> DataFrame:
    """mesh_id, looks_inverted, mean_exterior_winding: the winding seen from points around the mesh.

    Around a closed mesh the points lie on a sphere about the box's centre, twice half its diagonal; around an open one, at
    0.15 of half the diagonal about the area-weighted centroid. The mesh looks inverted when the mean is below -0.25.
    """
    box = bounds(mesh.vertices)
    c = corners(mesh).withColumn("w", 0.5 * V.norm(V.triangle_cross()))
    mid = lambda k: F.sum(F.col("w") * (F.col("a" + k).cast("double") + F.col("b" + k) + F.col("c" + k)) / 3) / F.sum("w")
    centroid = c.groupBy("mesh_id").agg(*(mid(k).alias("m" + k) for k in "xyz"))
    open_ = edges(mesh.triangles).groupBy("mesh_id").agg(F.max((F.col("n_tri") == 1).cast("int")).alias("open"))
    base = box.join(centroid.hint("merge"), "mesh_id").join(open_.hint("merge"), "mesh_id")
    half = F.col("diag") / 2
    r = F.when(F.col("open") == 1, F.greatest(0.15 * half, F.lit(1e-6))).otherwise(F.greatest(2 * half, F.lit(1e-6)))
    at = [F.when(F.col("open") == 1, F.col("m" + k)).otherwise((F.col("lo" + k) + F.col("hi" + k)) / 2) for k in "xyz"]
    dirs = F.array(*(F.struct(F.lit(i).alias("point_id"), *(F.lit(float(d)).alias("d" + k) for k, d in zip("xyz", v))) for i, v in enumerate(V.fibonacci_directions(samples))))
    pts = base.select("mesh_id", r.alias("r"), *(p.alias("q" + k) for p, k in zip(at, "xyz")), F.inline(dirs))
    pts = pts.select("mesh_id", "point_id", *((F.col("q" + k) + F.col("r") * F.col("d" + k)).alias("p" + k) for k in "xyz"))
    mean = winding_number(mesh, pts).groupBy("mesh_id").agg(F.avg("winding").alias("mean_exterior_winding"))
    return mean.select("mesh_id", (F.col("mean_exterior_winding") < -0.25).alias("looks_inverted"), "mean_exterior_winding")
