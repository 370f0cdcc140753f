"""How well index buffers use vertex caches and memory, and the local indices of meshlets."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import Mesh, halfedges
from tessera.operators.permesh import per_mesh

#: Bytes of a line and of the cache of the memory model; fixed values of the model.
LINE, CACHE = 64, 128 * 1024

CACHE_STATS = "mesh_id long, transformed long, warps long, acmr double, atvr double"


def vertex_cache(mesh: Mesh, cache: int = 16, warp: int = 0, group: int = 0) -> DataFrame:
    """mesh_id, transformed, warps, acmr (a triangle), atvr (a vertex in use): a first-in first-out cache of vertices over the triangles
    in order. It is emptied before a triangle that would be over ``warp`` new vertices or ``group`` triangles since the last time (0: no such
    limit). One mesh is one task: the cache is a sequence. Meshes without triangles give no row."""

    def run(mesh_id, p, t, ids):
        held: OrderedDict[int, None] = OrderedDict()
        done = warps = new = triangles = 0
        for row in t.tolist():
            missing = sum(v not in held for v in row)  # a corner that comes twice counts twice, as each is looked up
            if group and triangles == group or warp and new + missing > warp:
                warps += new > 0
                new = triangles = 0
                held.clear()
            for v in row:
                if v not in held:
                    held[v] = None
                    done, new = done + 1, new + 1
                    if len(held) > cache:
                        held.popitem(last=False)
            triangles += 1
        rows = [(mesh_id, done, warps + (new > 0), done / len(t), done / len(set(t.reshape(-1).tolist())))] if len(t) else []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CACHE_STATS.split(", ")])

    return per_mesh(mesh, run, CACHE_STATS)


def vertex_fetch(mesh: Mesh, vertex_size: int) -> DataFrame:
    """mesh_id, bytes_fetched, overfetch: lines of memory that a direct-mapped cache reads when vertices of so many bytes are read in
    the order of the indices. A place of the cache is read anew when the line that it held last was another: a window over each place."""
    at = halfedges(mesh.triangles).select("mesh_id", (3 * F.col("tid") + F.col("k")).alias("pos"), F.col("src").alias("vid"))
    start, stop = F.col("vid") * vertex_size, (F.col("vid") + 1) * vertex_size
    lines = at.withColumn("line", F.explode(F.sequence(F.floor(start / LINE), F.floor((stop - 1) / LINE))))
    place = Window.partitionBy("mesh_id", F.pmod("line", F.lit(CACHE // LINE))).orderBy("pos", "line")
    read = lines.withColumn("fetched", (~F.lag("line").over(place).eqNullSafe(F.col("line"))).cast("long"))
    sums = read.groupBy("mesh_id").agg((F.sum("fetched") * LINE).alias("bytes_fetched"))
    used = at.groupBy("mesh_id", "vid").agg(F.lit(1)).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(used.hint("merge"), "mesh_id").select("mesh_id", "bytes_fetched", (F.col("bytes_fetched") / (F.col("n") * vertex_size)).alias("overfetch"))


def meshlet_indices(triangles: DataFrame) -> DataFrame:
    """mesh_id, meshlet_id, tid, l0, l1, l2, n_vertices of triangles(mesh_id, meshlet_id, tid, i0, i1, i2): corners numbered in each
    meshlet by first use. Meshlets are small by definition, so each is numbered in a window of its own."""
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"i{k}").alias("vid")) for k in range(3))))
    c = triangles.select("mesh_id", "meshlet_id", "tid", corner.alias("c")).select("mesh_id", "meshlet_id", "tid", "c.k", "c.vid")
    first = c.groupBy("mesh_id", "meshlet_id", "vid").agg(F.min(3 * F.col("tid") + F.col("k")).alias("pos"))
    w = Window.partitionBy("mesh_id", "meshlet_id")
    local = first.select("mesh_id", "meshlet_id", "vid", (F.row_number().over(w.orderBy("pos")) - 1).cast("long").alias("l"), F.count(F.lit(1)).over(w).alias("n_vertices"))
    out = c.join(local.hint("merge"), ["mesh_id", "meshlet_id", "vid"]).groupBy("mesh_id", "meshlet_id", "tid")
    return out.agg(*(F.max(F.when(F.col("k") == k, F.col("l"))).alias(f"l{k}") for k in range(3)), F.max("n_vertices").alias("n_vertices"))


MESHLETS = "mesh_id long, meshlet_id long, tid long, i0 long, i1 long, i2 long"


def scanned_meshlets(mesh: Mesh, max_vertices: int = 64, max_triangles: int = 124) -> DataFrame:
    """The triangles with meshlet_id: runs of triangles in order, each as long as it has at most so many vertices and triangles. One mesh is
    one task: where a run ends depends on all before it."""
    if max_vertices < 3 or max_triangles < 1:
        raise ValueError("a meshlet holds a triangle at least")

    def run(mesh_id, p, t, ids):
        rows, seen, count, number = [], set(), 0, 0
        for tid, row in enumerate(t.tolist()):
            if count == max_triangles or len(seen.union(row)) > max_vertices:
                number, count, seen = number + 1, 0, set()
            seen.update(row)
            count += 1
            rows.append((mesh_id, number, tid, *(int(ids[v]) for v in row)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MESHLETS.split(", ")])

    return per_mesh(mesh, run, MESHLETS)
