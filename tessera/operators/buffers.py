"""Vertex and index buffer operations: remaps, shadow and adjacency indices, spatial order, pruning and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import Mesh, bounds, corners, halfedges
from tessera.operators.foundations import compacted, connected_components, remapped

POSITION = ("x", "y", "z")


def vertex_remap(mesh: Mesh, key: tuple[str, ...] = POSITION) -> DataFrame:
    """mesh_id, vid, wid: vertices equal in ``key`` share an id, numbered by first use in the triangles; unused ones have none."""
    used = mesh.triangles.select("mesh_id", F.posexplode(F.array("i0", "i1", "i2")).alias("k", "vid"), "tid")
    first = used.groupBy("mesh_id", "vid").agg(F.min(3 * F.col("tid") + F.col("k")).alias("at"))
    v = mesh.vertices.join(first.hint("merge"), ["mesh_id", "vid"])
    groups = v.groupBy("mesh_id", *key).agg(F.min("at").alias("g"))
    groups = groups.withColumn("wid", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("g")) - 1).cast("long"))
    return v.join(groups.hint("merge"), ["mesh_id", *key]).select("mesh_id", "vid", "wid")


def position_remap(mesh: Mesh, key: tuple[str, ...] = POSITION) -> DataFrame:
    """mesh_id, vid, first: the first vertex that is equal in ``key``."""
    there = mesh.vertices.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    return there.select("mesh_id", "vid", F.min("vid").over(Window.partitionBy("mesh_id", *key)).alias("first"))


def shadow_indices(mesh: Mesh, key: tuple[str, ...] = POSITION) -> DataFrame:
    """Triangles that point at the first vertex equal in ``key``."""
    return remapped(mesh.triangles, position_remap(mesh, key).withColumnRenamed("first", "wid"))


def adjacency_indices(mesh: Mesh) -> DataFrame:
    """mesh_id, tid, i0, n0, i1, n1, i2, n2: after each corner the vertex across its edge (the corner itself on a border).

    An edge that several triangles run in the other direction takes the lowest of them.
    """
    h = halfedges(shadow_indices(mesh))
    across = h.groupBy("mesh_id", F.col("src").alias("dst"), F.col("dst").alias("src")).agg(F.min_by("opp", "tid").alias("n"))
    n = h.join(across.hint("merge"), ["mesh_id", "src", "dst"], "left").groupBy("mesh_id", "tid").agg(*(F.max(F.when(F.col("k") == k, F.coalesce("n", "src"))).alias(f"n{k}") for k in range(3)))
    return mesh.triangles.join(n.hint("merge"), ["mesh_id", "tid"]).select("mesh_id", "tid", "i0", "n0", "i1", "n1", "i2", "n2")


def tessellation_indices(mesh: Mesh) -> DataFrame:
    """mesh_id, tid, i0..i2, the opposite edge of each side (o0a, o0b, ..: its own side turned, or itself on a border) and the first vertex at
    each corner's place (d0..d2). Sides meet by place, so seams are crossed."""
    at = remapped(mesh.triangles, position_remap(mesh).withColumnRenamed("first", "wid")).select("mesh_id", "tid", *(F.col(f"i{k}").alias(f"d{k}") for k in range(3)))
    ends = lambda n, k: (F.col(f"{n}{k}"), F.col(f"{n}{(k + 1) % 3}"))
    each = [F.struct(F.lit(k).alias("k"), *(c.alias(n) for n, c in zip(("src", "dst", "src_at", "dst_at"), (*ends("i", k), *ends("d", k))))) for k in range(3)]
    h = mesh.triangles.join(at.hint("merge"), ["mesh_id", "tid"]).select("mesh_id", "tid", F.inline(F.array(*each)))
    # of the sides between two places, the first that runs up and the first that runs down; a side without length is its own
    w = Window.partitionBy("mesh_id", F.least("src_at", "dst_at"), F.greatest("src_at", "dst_at"))
    up, down = (F.min(F.when(runs, F.struct("tid", "k", "src", "dst"))).over(w) for runs in (F.col("src_at") <= F.col("dst_at"), F.col("src_at") >= F.col("dst_at")))
    side = h.select("*", F.when(F.col("src_at") <= F.col("dst_at"), down).otherwise(up).alias("o")).select(
        "mesh_id", "tid", "k", F.col("src").alias("i"), F.coalesce("o.dst", "src").alias("a"), F.coalesce("o.src", "dst").alias("b"), F.col("src_at").alias("d")
    )
    each = [F.max(F.when(F.col("k") == k, F.col(c))).alias(n) for k in range(3) for c, n in (("i", f"i{k}"), ("a", f"o{k}a"), ("b", f"o{k}b"), ("d", f"d{k}"))]
    return side.groupBy("mesh_id", "tid").agg(*each)


def optimized_fetch(mesh: Mesh) -> Mesh:
    """The mesh with vertices in order of first use."""
    return compacted(mesh)


def remapped_vertices(mesh: Mesh, mapping: DataFrame) -> DataFrame:
    """Vertices under their new ids; of those that share one, the first."""
    v = mesh.vertices.join(mapping.hint("merge"), ["mesh_id", "vid"])
    return v.groupBy("mesh_id", F.col("wid").alias("vid")).agg(*(F.min_by(c, "vid").alias(c) for c in POSITION))


def _morton(cols) -> F.Column:
    """Interleaved bits of three 16-bit columns."""
    out = F.lit(0).cast("long")
    for bit in range(16):
        for k, c in enumerate(cols):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + k))
    return out


def _cells(df: DataFrame, box: DataFrame, names, steps: int) -> list:
    return [F.floor((F.col(n).cast("double") - F.col("lo" + c)) / F.when(F.col("extent") > 0, F.col("extent")).otherwise(1.0) * (steps - 1) + 0.5).cast("long") for n, c in zip(names, "xyz")]


def spatial_order(mesh: Mesh) -> DataFrame:
    """mesh_id, vid, place: vertices along a Morton curve of 16 bits to an axis."""
    v = mesh.vertices.join(bounds(mesh.vertices).hint("merge"), "mesh_id")
    m = v.select("mesh_id", "vid", _morton(_cells(v, v, POSITION, 1 << 16)).alias("m"))
    return m.select("mesh_id", "vid", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("m", "vid")) - 1).cast("long").alias("place"))


def spatial_triangle_order(mesh: Mesh) -> DataFrame:
    """mesh_id, tid, place: triangles along the Morton curve of their centroids."""
    c = corners(mesh).join(bounds(mesh.vertices).hint("merge"), "mesh_id")
    for k in "xyz":
        c = c.withColumn("m" + k, (F.col("a" + k).cast("double") + F.col("b" + k) + F.col("c" + k)) / 3)
    m = c.select("mesh_id", "tid", _morton(_cells(c, c, ("mx", "my", "mz"), 1 << 16)).alias("m"))
    return m.select("mesh_id", "tid", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("m", "tid")) - 1).cast("long").alias("place"))


def pruned(mesh: Mesh, error: float) -> DataFrame:
    """The triangles of components whose radius about the mean of their vertices is above ``error`` times the extent."""
    _, owned = connected_components(mesh)
    ids = owned.join(mesh.triangles.hint("merge"), ["mesh_id", "tid"]).select("mesh_id", "region_id", F.explode(F.array("i0", "i1", "i2")).alias("vid")).distinct()
    p = ids.join(mesh.vertices.hint("merge"), ["mesh_id", "vid"])
    mean = p.groupBy("mesh_id", "region_id").agg(*(F.avg(c).alias("m" + c) for c in POSITION))
    gap = sum((F.col(c) - F.col("m" + c)) * (F.col(c) - F.col("m" + c)) for c in POSITION)
    r = p.join(mean.hint("merge"), ["mesh_id", "region_id"]).groupBy("mesh_id", "region_id").agg(F.max(gap).alias("r2"))
    keep = r.join(bounds(mesh.vertices).hint("merge"), "mesh_id").where(F.col("r2") > F.pow(F.lit(error) * F.col("extent"), 2)).select("mesh_id", "region_id")
    return owned.join(keep.hint("merge"), ["mesh_id", "region_id"]).select("mesh_id", "tid").join(mesh.triangles.hint("merge"), ["mesh_id", "tid"])


def clustered_points(mesh: Mesh, grid: int) -> DataFrame:
    """mesh_id, vid: of each cell of a grid the vertex nearest to the mean of its cell, the lowest id on ties."""
    v = mesh.vertices.join(bounds(mesh.vertices).hint("merge"), "mesh_id")
    v = v.select("mesh_id", "vid", *POSITION, *(c.alias(n) for c, n in zip(_cells(v, v, POSITION, grid), ("cx", "cy", "cz"))))
    cell = ["mesh_id", "cx", "cy", "cz"]
    mean = v.groupBy(*cell).agg(*(F.avg(c).alias("m" + c) for c in POSITION))
    gap = sum((F.col(c) - F.col("m" + c)) * (F.col(c) - F.col("m" + c)) for c in POSITION)
    return v.join(mean.hint("merge"), cell).groupBy(*cell).agg(F.min(F.struct(F.round(gap, 9).alias("d"), "vid")).alias("m")).select("mesh_id", F.col("m.vid").alias("vid"))


def sloppy(mesh: Mesh, grid: int) -> DataFrame:
    """Triangles after clustering vertices by a grid: a cell's vertex is the one of least quadric error; collapsed and repeated triangles drop out."""
    from tessera.operators.decimation import vertex_quadrics

    v = mesh.vertices.join(bounds(mesh.vertices).hint("merge"), "mesh_id")
    v = v.select("mesh_id", "vid", *POSITION, *(c.alias(n) for c, n in zip(_cells(v, v, POSITION, grid), ("cx", "cy", "cz"))))
    q = vertex_quadrics(mesh)
    names = [c for c in q.columns if c.startswith("q")]
    cell = ["mesh_id", "cx", "cy", "cz"]
    joined = v.join(q.hint("merge"), ["mesh_id", "vid"])
    sums = joined.groupBy(*cell).agg(*(F.sum(c).alias("s" + c) for c in names))
    x, y, z = (F.col(c).cast("double") for c in POSITION)
    s = {n: F.col("s" + n) for n in names}
    err = s["qxx"] * x * x + s["qyy"] * y * y + s["qzz"] * z * z + 2 * (s["qxy"] * x * y + s["qxz"] * x * z + s["qyz"] * y * z) + 2 * (s["qx"] * x + s["qy"] * y + s["qz"] * z) + s["qc"]
    best = joined.select(*cell, "vid", *POSITION).join(sums.hint("merge"), cell).groupBy(*cell).agg(F.min(F.struct(F.round(F.abs(err), 9).alias("e"), "vid")).alias("b"))
    mapping = v.join(best.hint("merge"), cell).select("mesh_id", "vid", F.col("b.vid").alias("wid"))
    t = remapped(mesh.triangles, mapping).where("i0 <> i1 AND i1 <> i2 AND i0 <> i2").withColumn("s", F.array_sort(F.array("i0", "i1", "i2")))
    return t.groupBy("mesh_id", "s").agg(F.min(F.struct("tid", "i0", "i1", "i2")).alias("t")).select("mesh_id", "t.*")
