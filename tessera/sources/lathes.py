"""Meshes of known shape built from a table: open sides of tubes, cones, globes and hexagonal prisms, one for each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import Mesh, dealt

#: Points around, and rings of them.
AROUND, RINGS = 24, 7
KINDS = ("tube", "cone", "globe", "prism")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mesh_id, kind (0 to 3), r (radius, 2 to 6), h (height, 6 to 9) of every supplier."""
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey IS NOT NULL")
    return t.selectExpr("cast(s_suppkey AS long) AS mesh_id", "cast(s_suppkey % 4 AS int) AS kind", "2D + (s_suppkey div 4) % 5 AS r", "6D + (s_suppkey div 20) % 4 AS h")


def lathes(of: DataFrame) -> Mesh:
    """The meshes of shapes(): ring i of points j, with quadrangles cut along alternating diagonals; the outside is counterclockwise."""
    of = dealt(of, AROUND * RINGS)
    step = 6.283185307179586 / AROUND
    ring = "cast(vid div {n} AS double)".format(n=AROUND)
    v = of.withColumn("vid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(AROUND * RINGS - 1).cast("long")))).selectExpr("*", f"{ring} / {RINGS - 1} AS u", f"vid % {AROUND} AS j")
    v = v.selectExpr("*", "CASE kind WHEN 1 THEN r * (1 - u / 2) WHEN 2 THEN r * cos(radians(120 * u - 60)) ELSE r END AS rho", "CASE kind WHEN 2 THEN r * sin(radians(120 * u - 60)) ELSE h * u END AS z")
    # a prism's point lies between the corners of its side, a round one on the circle
    side, part = f"(j div {AROUND // 6})", f"((j % {AROUND // 6}) / {AROUND / 6})"
    corner = lambda f: f"rho * (f({side} * pi() / 3) * (1 - {part}) + f(({side} + 1) * pi() / 3) * {part})".replace("f(", f"{f}(")
    v = v.selectExpr("mesh_id", "vid", *(f"cast(CASE kind WHEN 3 THEN {corner(f)} ELSE rho * {f}(j * {step!r}D) END AS float) AS {c}" for c, f in (("x", "cos"), ("y", "sin"))), "cast(z AS float) AS z")
    q = of.select("mesh_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(AROUND * (RINGS - 1) - 1).cast("long"))).alias("q"))
    q = q.selectExpr("mesh_id", "q", "q AS a", f"(q div {AROUND}) * {AROUND} + (q + 1) % {AROUND} AS b").selectExpr("*", f"a + {AROUND} AS d", f"b + {AROUND} AS c", f"((q div {AROUND}) + q % {AROUND}) % 2 = 0 AS even")
    two = [("2 * q", "a", "b", "if(even, c, d)"), ("2 * q + 1", "if(even, a, b)", "c", "d")]
    both = ", ".join(f"struct({t} AS tid, {x} AS i0, {y} AS i1, {z} AS i2)" for t, x, y, z in two)
    return Mesh(v, q.selectExpr("mesh_id", f"inline(array({both}))"))


#: The same shapes in SQL for DuckDB.
SHAPES_SQL = "S AS (SELECT s_suppkey::BIGINT AS mesh_id, s_suppkey % 4 AS kind, (2.0 + (s_suppkey // 4) % 5)::DOUBLE AS r, (6.0 + (s_suppkey // 20) % 4)::DOUBLE AS h FROM supplier WHERE s_suppkey IS NOT NULL)"
