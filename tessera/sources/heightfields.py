"""Meshes built from tables: a grid of heights, cut into many meshes, and its soup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.model import Mesh, dealt, halfedges


def heightfield(points: DataFrame, key: str, height: str, width: int, rows_per_mesh: int) -> Mesh:
    """Points with gap-free keys from 0 become grids ``width`` wide and ``rows_per_mesh`` deep, two triangles to a cell."""
    per = width * rows_per_mesh
    p = dealt(points.select(F.col(key).cast("long").alias("k"), F.col(height).cast("double").alias("h")).withColumn("mesh_id", F.expr(f"k div {per}")), 1)
    v = p.selectExpr("mesh_id", f"k % {per} AS vid", f"cast(k % {width} AS float) AS x", f"cast((k % {per}) div {width} AS float) AS y", "cast(h AS float) AS z")
    cells = v.withColumn("top", F.max("vid").over(Window.partitionBy("mesh_id"))).where((F.col("x") < width - 1) & (F.col("vid") + width + 1 <= F.col("top")))
    two = F.array(
        F.struct((2 * F.col("vid")).alias("tid"), F.col("vid").alias("i0"), (F.col("vid") + 1).alias("i1"), (F.col("vid") + width + 1).alias("i2")),
        F.struct((2 * F.col("vid") + 1).alias("tid"), F.col("vid").alias("i0"), (F.col("vid") + width + 1).alias("i1"), (F.col("vid") + width).alias("i2")),
    )
    return Mesh(v, cells.select("mesh_id", F.inline(two)))


def parts(spark: SparkSession, sf_dir: str) -> Mesh:
    """Strips of 40 x 5 points over part, the height from the price."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    return heightfield(t.select("p_partkey", (F.col("p_retailprice") / 100).alias("h")), "p_partkey", "h", 40, 5)


def orders(spark: SparkSession, sf_dir: str) -> Mesh:
    """Grids of 100 x 150 points over orders, the height from the price."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return heightfield(t.select("o_orderkey", (F.col("o_totalprice") / 20000).alias("h")), "o_orderkey", "h", 100, 150)


def soup(mesh: Mesh) -> Mesh:
    """The mesh with three fresh vertices to a triangle."""
    h = halfedges(mesh.triangles).select("mesh_id", "tid", "k", F.col("src").alias("vid"))
    v = h.join(mesh.vertices.hint("merge"), ["mesh_id", "vid"]).select("mesh_id", (3 * F.col("tid") + F.col("k")).alias("vid"), "x", "y", "z")
    t = mesh.triangles.select("mesh_id", "tid", *((3 * F.col("tid") + k).alias(f"i{k}") for k in range(3)))
    return Mesh(v, t)


#: The same meshes for DuckDB: CTEs V and T (strips over part), and SV, ST (their soup).
PARTS_SQL = """
V AS MATERIALIZED (SELECT p_partkey // 200 AS mesh_id, p_partkey % 200 AS vid, (p_partkey % 40)::FLOAT AS x, ((p_partkey % 200) // 40)::FLOAT AS y, (p_retailprice / 100)::FLOAT AS z FROM part),
CELL AS (SELECT a.mesh_id, a.vid FROM V a JOIN V b ON b.mesh_id = a.mesh_id AND b.vid = a.vid + 41 WHERE a.x < 39),
T AS MATERIALIZED (SELECT mesh_id, 2 * vid AS tid, vid AS i0, vid + 1 AS i1, vid + 41 AS i2 FROM CELL UNION ALL SELECT mesh_id, 2 * vid + 1, vid, vid + 41, vid + 40 FROM CELL),
SV AS (SELECT T.mesh_id, 3 * tid + k AS vid, x, y, z FROM T, (SELECT unnest([0, 1, 2]) AS k) JOIN V ON V.mesh_id = T.mesh_id AND V.vid = CASE k WHEN 0 THEN i0 WHEN 1 THEN i1 ELSE i2 END),
ST AS (SELECT mesh_id, tid, 3 * tid AS i0, 3 * tid + 1 AS i1, 3 * tid + 2 AS i2 FROM T)"""
