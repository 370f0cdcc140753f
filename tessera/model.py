"""Meshes as relations: vertices(mesh_id, vid, x, y, z) and triangles(mesh_id, tid, i0, i1, i2).

Joins carry the hint ``merge``: Spark takes exploded tables for as small as the file they come from and would gather them on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTICES = "mesh_id long, vid long, x float, y float, z float"
TRIANGLES = "mesh_id long, tid long, i0 long, i1 long, i2 long"


#: Vertices to a partition of a source's meshes.
FILL = 1 << 16


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    triangles: DataFrame


def dealt(rows: DataFrame, vertices: int) -> DataFrame:
    """Rows that stand for so many vertices each, dealt by mesh_id to partitions of about FILL vertices (and one for each core at least).

    Small files are one task to Spark, whatever is made of them. What is dealt by mesh_id also groups without another shuffle, and meets
    without one after joined_where_dealt().
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() * vertices / FILL)), "mesh_id")


def joined_where_dealt(spark: SparkSession, on: bool) -> None:
    """Joins by mesh_id and more stay where both sides were dealt by mesh_id, or (``on`` false) the session's own setting holds again.

    Spark would shuffle both sides by all keys, to as many partitions as the session names, however large the tables are.
    """
    name, own = "spark.sql.requireAllClusterKeysForCoPartition", "_tessera_co_partition"
    if on and not hasattr(spark, own):
        setattr(spark, own, spark.conf.get(name, "true"))
    if hasattr(spark, own):
        spark.conf.set(name, "false" if on else getattr(spark, own))


def corners(mesh: Mesh) -> DataFrame:
    """Every triangle with the positions of its corners: mesh_id, tid, i0..i2, ax..cz. Indices without a vertex drop out."""
    out = mesh.triangles
    for k, p in enumerate("abc"):
        v = mesh.vertices.select("mesh_id", F.col("vid").alias(f"i{k}"), *(F.col(c).alias(p + c) for c in "xyz"))
        out = out.join(v.hint("merge"), ["mesh_id", f"i{k}"])
    return out.select("mesh_id", "tid", "i0", "i1", "i2", *(p + c for p in "abc" for c in "xyz"))


def halfedges(triangles: DataFrame) -> DataFrame:
    """The three directed edges of every triangle: mesh_id, tid, k, src, dst, lo, hi, opp (the third vertex)."""
    e = [F.struct(F.lit(k).alias("k"), F.col(f"i{k}").alias("src"), F.col(f"i{(k + 1) % 3}").alias("dst"), F.col(f"i{(k + 2) % 3}").alias("opp")) for k in range(3)]
    out = triangles.select("mesh_id", "tid", F.inline(F.array(*e)))
    return out.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))


def edges(triangles: DataFrame) -> DataFrame:
    """Undirected edges: mesh_id, lo, hi, n_tri, n_fwd (traversals from lo to hi)."""
    return halfedges(triangles).groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n_tri"), F.sum((F.col("src") == F.col("lo")).cast("long")).alias("n_fwd"))


def bounds(vertices: DataFrame) -> DataFrame:
    """Per mesh: the box lox .. hiz (double), its diagonal and its largest extent."""
    b = vertices.groupBy("mesh_id").agg(*(f(F.col(c).cast("double")).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    d = [F.col("hi" + c) - F.col("lo" + c) for c in "xyz"]
    return b.withColumn("diag", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).withColumn("extent", F.greatest(*d))
