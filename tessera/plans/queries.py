"""Queries over meshes built from the tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import quantize
from tessera.functions import vec as V
from tessera.model import Mesh, bounds, corners, edges, halfedges
from tessera.operators import analysis, buffers, decimation, foundations, rendering, segmentation, slicing, winding
from tessera.plans import shapes
from tessera.sources import heightfields
from tessera.sources.heightfields import PARTS_SQL

PLANES = [slicing.CutPlane((0.0, 0.0, 9.5), (0.0, 0.0, 1.0)), slicing.CutPlane((10.25, 0.0, 0.0), (1.0, 0.0, 0.0))]
POINTS = ((3.3, 1.7, 0.0), (20.2, 2.1, 60.0), (-5.0, 8.0, 10.0))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles and floats rounded (and no negative zero), so that sums in another order agree."""
    return df.select(*((F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


def _holes(mesh: Mesh) -> Mesh:
    """The mesh without every third run of seven triangles: several components."""
    return Mesh(mesh.vertices, mesh.triangles.where("(tid div 7) % 3 <> 0"))


def summary(mesh: Mesh) -> DataFrame:
    e = edges(mesh.triangles).groupBy("mesh_id").agg(F.sum((F.col("n_tri") == 1).cast("long")).alias("n_boundary"), F.sum((F.col("n_tri") > 2).cast("long")).alias("n_nonmanifold"))
    a = foundations.areas(mesh).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_tri"), F.sum("area").alias("area"))
    return rounded(a.join(e.hint("merge"), "mesh_id"))


def _adjacency(m: Mesh) -> DataFrame:
    return foundations.triangle_adjacency(m).select("mesh_id", "tid", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


def _winding(m: Mesh) -> DataFrame:
    pts = F.array(*(F.struct(F.lit(i).cast("long").alias("point_id"), *(F.lit(c).alias("p" + k) for k, c in zip("xyz", p))) for i, p in enumerate(POINTS)))
    return winding.winding_number(m, m.vertices.select("mesh_id").distinct().select("mesh_id", F.inline(pts)))


def _segments(m: Mesh) -> DataFrame:
    s = slicing.segments(m, PLANES)
    gap = V.norm(V.sub(V.vec("p"), V.vec("q")))
    return s.groupBy("mesh_id", "plane_id").agg(F.count(F.lit(1)).alias("n"), F.sum(gap).alias("length"))


def _region(m: Mesh) -> DataFrame:
    return foundations.area_of(m, m.triangles.select("mesh_id", (F.col("tid") % 5).alias("region_id"), "tid"))


def _mean_edge(m: Mesh) -> DataFrame:
    h = halfedges(m.triangles)
    at = m.vertices
    for k in ("src", "dst"):
        h = h.join(at.select("mesh_id", F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in "xyz")).hint("merge"), ["mesh_id", k])
    return h.groupBy("mesh_id").agg(F.avg(V.norm(V.sub(V.vec("src"), V.vec("dst")))).alias("mean_edge"))


def _quantized(m: Mesh) -> DataFrame:
    """Heights in their mesh's extent at 14 and 8 bits, as half numbers, with 7 bits of mantissa, and back."""
    at = m.vertices.join(bounds(m.vertices).select("mesh_id", "loz", "extent").hint("merge"), "mesh_id")
    u = (F.col("z").cast("double") - F.col("loz")) / F.col("extent")
    rows = at.select("mesh_id", "vid", quantize.unorm(u, 14).alias("u14"), quantize.snorm(u * 2 - 1, 8).alias("s8"), quantize.half(F.col("z") - 10).alias("h"), quantize.shortened(F.col("z"), 7).alias("short"))
    return rows.select("*", quantize.from_unorm(F.col("u14"), 14).alias("u"), quantize.from_snorm(F.col("s8"), 8).alias("s"), quantize.from_half(F.col("h")).alias("back"))


def _octahedral(m: Mesh) -> DataFrame:
    """Face normals in octahedral coordinates of 8 bits, and the vectors that come back."""
    n = foundations.face_normals(m)
    u, v = quantize.octahedral(F.col("nx"), F.col("ny"), F.col("nz"), 8)
    rows = n.select("mesh_id", "tid", u.alias("u"), v.alias("v"))
    return rows.select("*", *(c.alias(k) for c, k in zip(quantize.from_octahedral(F.col("u"), F.col("v"), 8), "xyz")))


def _quaternions(m: Mesh) -> DataFrame:
    """Quaternions from positions, in 12 bits, and what comes back."""
    x, y, z = V.vec("")
    size = F.sqrt((x - 15.5) * (x - 15.5) + (y - 2.25) * (y - 2.25) + (z - 10.125) * (z - 10.125) + 36.0)
    q = m.vertices.select("mesh_id", "vid", *((c / size).alias(f"q{k}") for k, c in enumerate((x - 15.5, y - 2.25, z - 10.125, F.lit(-6.0)))))
    d = q.select("mesh_id", "vid", *(c.alias(f"d{k}") for k, c in enumerate(quantize.quaternion(tuple(F.col(f"q{k}") for k in range(4)), 12))))
    return d.select("*", *(c.alias(f"b{k}") for k, c in enumerate(quantize.from_quaternion(tuple(F.col(f"d{k}") for k in range(4))))))


def _exponentials(m: Mesh) -> DataFrame:
    """Heights and places with powers of their own, of their vertex, of their mesh's column, and clamped ones, and the heights that come back."""
    v = m.vertices.select("mesh_id", "vid", *((F.col(c).cast("double") - o).alias(c) for c, o in (("x", 7.25), ("y", 2.5), ("z", 10.125))))
    shared = v.groupBy("mesh_id").agg(F.max(quantize.power(F.col("z"))).alias("of_column"))
    z, own = F.col("z"), quantize.power(F.col("z"))
    of_vector = F.greatest(*(quantize.power(F.col(c)) for c in "xyz"))
    rows = v.join(shared.hint("merge"), "mesh_id").select("mesh_id", "vid", *(quantize.exponential(z, p, 12).alias(n) for n, p in (("own", own), ("vector", of_vector), ("component", F.col("of_column")), ("clamped", quantize.power(z, 0)))))
    return rows.select("*", *(quantize.from_exponential(F.col(n)).alias(n + "_back") for n in ("own", "vector", "component", "clamped")))


def _colors(m: Mesh) -> DataFrame:
    """Places in their mesh's extent as colours of 8 bits, in another colour space, and back."""
    at = m.vertices.join(bounds(m.vertices).hint("merge"), "mesh_id")
    r, g, b = ((F.col(c).cast("double") - F.col("lo" + c)) / F.col("extent") for c in "xyz")
    c = at.select("mesh_id", "vid", *(k.alias(n) for k, n in zip(quantize.color(r, g, b, (r + g) / 2, 8), ("luma", "orange", "lime", "alpha"))))
    return c.select("*", *(k.alias(n) for k, n in zip(quantize.from_color(*(F.col(n) for n in ("luma", "orange", "lime", "alpha"))), "rgba")))


def _turned(t: DataFrame, names: tuple[str, str, str], *more: str) -> DataFrame:
    """Triangles turned so that the least index comes first."""
    a, b, c = names
    first = F.least(*names)
    turn = lambda x, y, z: F.when(F.col(a) == first, F.col(x)).when(F.col(b) == first, F.col(y)).otherwise(F.col(z))
    return t.select("mesh_id", *more, first.alias("a"), turn(b, c, a).alias("b"), turn(c, a, b).alias("c"))


def _integrity(m: Mesh) -> DataFrame:
    return foundations.integrity_report(heightfields.soup(m))


ON_PARTS: dict[str, Callable[[Mesh], DataFrame]] = {
    "mesh_summary": summary,
    "mesh_face_normals": foundations.face_normals,
    "mesh_vertex_normals": foundations.vertex_normals,
    "mesh_weld_map": lambda m: foundations.weld_map(heightfields.soup(m).vertices).select("mesh_id", "vid", "wid"),
    "mesh_welded": lambda m: foundations.welded(heightfields.soup(m)).triangles,
    "mesh_adjacency": _adjacency,
    "mesh_components": lambda m: foundations.connected_components(_holes(m))[0],
    "mesh_sub_mesh": lambda m: foundations.sub_mesh(m, m.triangles.where("tid % 3 = 0").select("mesh_id", (-F.col("tid")).alias("ordinal"), "tid")).triangles,
    "mesh_integrity": _integrity,
    "mesh_shape_stats": foundations.shape_stats,
    "mesh_region_area": _region,
    "mesh_quantized": _quantized,
    "mesh_octahedral": _octahedral,
    "mesh_bounds": lambda m: bounds(m.vertices),
    "mesh_mean_edge": _mean_edge,
    "mesh_winding": _winding,
    "mesh_slice_segments": _segments,
    "mesh_smooth_regions": lambda m: segmentation.smooth_regions(m, 3.0),
    "mesh_simplify_scale": decimation.simplify_scale,
    "mesh_vertex_quadrics": decimation.vertex_quadrics,
    "mesh_vertex_kinds": lambda m: decimation.vertex_kinds(_holes(m)),
    "mesh_border_quadrics": lambda m: decimation.border_quadrics(_holes(m)),
    "mesh_sloppy": lambda m: buffers.sloppy(m, 12),
    "mesh_pruned": lambda m: buffers.pruned(_holes(m), 0.05),
    "mesh_clustered_points": lambda m: buffers.clustered_points(m, 12),
    "mesh_vertex_remap": lambda m: buffers.vertex_remap(heightfields.soup(m)),
    "mesh_position_remap": lambda m: buffers.position_remap(heightfields.soup(m)),
    "mesh_shadow_indices": lambda m: buffers.shadow_indices(heightfields.soup(m)),
    "mesh_adjacency_indices": buffers.adjacency_indices,
    "mesh_tessellation_indices": lambda m: buffers.tessellation_indices(heightfields.soup(m)),
    "mesh_vertex_cache": lambda m: analysis.vertex_cache(m, 400),
    "mesh_vertex_fetch": lambda m: analysis.vertex_fetch(m, 40),
    "mesh_meshlet_indices": lambda m: analysis.meshlet_indices(m.triangles.withColumn("meshlet_id", F.expr("tid div 48"))),
    "mesh_scanned_meshlets": lambda m: analysis.scanned_meshlets(m, 1000, 32),
    "mesh_strips": lambda m: _turned(rendering.unstripped(rendering.strips(m)), ("i0", "i1", "i2")),
    "mesh_provoking": lambda m: _turned(rendering.provoking_indices(m), ("v0", "v1", "v2"), "tid", "i0"),
    "mesh_quaternions": _quaternions,
    "mesh_exponentials": _exponentials,
    "mesh_colors": _colors,
    "mesh_fetch_order": lambda m: foundations.first_use(m.triangles),
    "mesh_spatial_order": buffers.spatial_order,
    "mesh_spatial_triangles": buffers.spatial_triangle_order,
}


def _query(run: Callable[[Mesh], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(run(heightfields.parts(spark, sf_dir)))


def _halved(mesh: Mesh) -> DataFrame:
    """Half of the triangles of each mesh: counts, and the ground that the result covers."""
    out = decimation.simplified(mesh, decimation.SimplifyOptions(target_reduction=0.5)).select("mesh_id", "before", "after", "vertices", F.explode("triangles").alias("t"))
    (ax, ay), (bx, by), (cx, cy) = ([F.col("vertices")[F.col("t")[k]][c] for c in range(2)] for k in range(3))
    return out.groupBy("mesh_id", "before", "after").agg(F.round(F.sum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2, 3).alias("ground"))


ON_ORDERS: dict[str, Callable[[Mesh], DataFrame]] = {"mesh_summary_orders": summary, "mesh_simplified_orders": _halved}
QUERIES = {name: _query(run) for name, run in ON_PARTS.items()} | {name: (lambda spark, sf_dir, run=run: run(heightfields.orders(spark, sf_dir))) for name, run in ON_ORDERS.items()}

C_SQL = """
C AS MATERIALIZED (SELECT T.*, a.x::DOUBLE ax, a.y::DOUBLE ay, a.z::DOUBLE az, b.x::DOUBLE bx, b.y::DOUBLE "by", b.z::DOUBLE bz, c.x::DOUBLE cx, c.y::DOUBLE cy, c.z::DOUBLE cz
      FROM T JOIN V a ON a.mesh_id * 1000000 + a.vid = T.mesh_id * 1000000 + i0 JOIN V b ON b.mesh_id * 1000000 + b.vid = T.mesh_id * 1000000 + i1 JOIN V c ON c.mesh_id * 1000000 + c.vid = T.mesh_id * 1000000 + i2),
N AS (SELECT *, ("by" - ay) * (cz - az) - (bz - az) * (cy - ay) AS rx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ry, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) AS rz FROM C),
L AS MATERIALIZED (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS len FROM N),
H AS MATERIALIZED (SELECT mesh_id, tid, 0 AS k, i0 AS src, i1 AS dst, i2 AS opp FROM T UNION ALL SELECT mesh_id, tid, 1, i1, i2, i0 FROM T UNION ALL SELECT mesh_id, tid, 2, i2, i0, i1 FROM T),
E AS MATERIALIZED (SELECT mesh_id, least(src, dst) AS lo, greatest(src, dst) AS hi, count(*) AS n_tri, count(*) FILTER (WHERE src < dst) AS n_fwd FROM H GROUP BY ALL),
BOX AS (SELECT mesh_id, min(x::DOUBLE) lox, max(x::DOUBLE) hix, min(y::DOUBLE) loy, max(y::DOUBLE) hiy, min(z::DOUBLE) loz, max(z::DOUBLE) hiz FROM V GROUP BY 1),
B AS (SELECT *, sqrt((hix - lox) ** 2 + (hiy - loy) ** 2 + (hiz - loz) ** 2) AS diag, greatest(hix - lox, hiy - loy, hiz - loz) AS extent FROM BOX)"""


def _sql(select: str, more: str = "", holes: bool = False, recursive: bool = False) -> str:
    base = PARTS_SQL
    if holes:
        base = base.replace("\nT AS MATERIALIZED (", "\nT0 AS MATERIALIZED (").replace(",\nSV AS", ",\nT AS MATERIALIZED (SELECT * FROM T0 WHERE (tid // 7) % 3 <> 0),\nSV AS")
    return f"WITH {'RECURSIVE ' if recursive else ''}{base},{C_SQL}{',' + more if more else ''}\n{select}"


_SUM = "count(*) AS n_tri, round(sum(len / 2), 4) AS area"
_R = lambda *cols: ", ".join(f"round({c}, 4) + 0.0 AS {n}" for c, n in cols)
_REACH = """
P AS (SELECT DISTINCT mesh_id, a, b FROM ({links})),
R AS (SELECT mesh_id, node, node AS label FROM ({nodes}) UNION SELECT R.mesh_id, P.b, R.label FROM R JOIN P ON P.mesh_id = R.mesh_id AND P.a = R.node WHERE P.b > R.label),
LAB AS (SELECT mesh_id, node, min(label) AS label FROM R GROUP BY ALL)"""
_VERTEX_LINKS = _REACH.format(links="SELECT mesh_id, src AS a, dst AS b FROM H UNION ALL SELECT mesh_id, dst, src FROM H", nodes="SELECT DISTINCT mesh_id, src AS node FROM H")
_LEAST_FIRST = "least(i0, i1, i2) AS a, CASE least(i0, i1, i2) WHEN i0 THEN i1 WHEN i1 THEN i2 ELSE i0 END AS b, CASE least(i0, i1, i2) WHEN i0 THEN i2 WHEN i1 THEN i0 ELSE i1 END AS c"
_PLANES = "K0 AS (SELECT mesh_id, unnest([i0, i1, i2]) AS vid, rx / len AS x, ry / len AS y, rz / len AS z, sqrt(len) AS w, ax, ay, az FROM L WHERE len > 0), K AS (SELECT *, -(x * ax + y * ay + z * az) AS d FROM K0)"
_KINDS = """
OPEN AS (SELECT mesh_id, CASE WHEN n_fwd > 0 THEN lo ELSE hi END AS src, CASE WHEN n_fwd > 0 THEN hi ELSE lo END AS dst FROM E WHERE n_fwd IN (0, n_tri)),
KI AS (SELECT mesh_id, vid, CASE WHEN max(n_out) = 0 AND max(n_in) = 0 THEN 'manifold' WHEN max(n_out) <= 1 AND max(n_in) <= 1 THEN 'border' ELSE 'locked' END AS kind FROM (
  SELECT mesh_id, src AS vid, 0 AS n_out, 0 AS n_in FROM H UNION ALL SELECT mesh_id, src, count(*), 0 FROM OPEN GROUP BY 1, 2 UNION ALL SELECT mesh_id, dst, 0, count(*) FROM OPEN GROUP BY 1, 2) GROUP BY 1, 2)"""
_MORTON = " + ".join(f"((({{{k}}} >> {b}) & 1) << {3 * b + k})" for b in range(16) for k in range(3))
_CELL = "floor(({v} - lo{c}) / CASE WHEN extent > 0 THEN extent ELSE 1 END * {m} + 0.5)::BIGINT"


def _angle(p: tuple[float, float, float]) -> str:
    a, b, c = ([f"({k}{x} - ({q}))" for x, q in zip("xyz", p)] for k in "abc")
    dot = lambda u, v: "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v)) + ")"
    q = lambda s: s.replace("(by", '("by')
    a, b, c = ([q(x).replace('("by', '("by"') for x in u] for u in (a, b, c))
    over = f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) + {a[1]} * ({b[2]} * {c[0]} - {b[0]} * {c[2]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    la, lb, lc = (f"sqrt({dot(u, u)})" for u in (a, b, c))
    return f"2 * atan2({over}, {la} * {lb} * {lc} + {dot(a, b)} * {lc} + {dot(b, c)} * {la} + {dot(c, a)} * {lb})"


SQL = {
    "mesh_summary": _sql(f"SELECT mesh_id, n_tri, area, n_boundary, n_nonmanifold FROM (SELECT mesh_id, {_SUM} FROM L GROUP BY 1) JOIN (SELECT mesh_id, count(*) FILTER (WHERE n_tri = 1) AS n_boundary, count(*) FILTER (WHERE n_tri > 2) AS n_nonmanifold FROM E GROUP BY 1) USING (mesh_id)"),
    "mesh_face_normals": _sql(f"SELECT mesh_id, tid, {_R(('rx / len', 'nx'), ('ry / len', 'ny'), ('rz / len', 'nz'))} FROM L"),
    "mesh_vertex_normals": _sql(
        f"SELECT mesh_id, vid, {_R(('CASE WHEN s > 1e-12 THEN sx / s ELSE 0 END', 'nx'), ('CASE WHEN s > 1e-12 THEN sy / s ELSE 0 END', 'ny'), ('CASE WHEN s > 1e-12 THEN sz / s ELSE 1 END', 'nz'))} FROM S",
        "S0 AS (SELECT V.mesh_id, V.vid, coalesce(sum(rx), 0) sx, coalesce(sum(ry), 0) sy, coalesce(sum(rz), 0) sz FROM V LEFT JOIN L ON L.mesh_id = V.mesh_id AND V.vid IN (i0, i1, i2) GROUP BY 1, 2), S AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS s FROM S0)",
    ),
    "mesh_weld_map": _sql("SELECT mesh_id, vid, dense_rank() OVER (PARTITION BY mesh_id ORDER BY rep) - 1 AS wid FROM (SELECT mesh_id, vid, min(vid) OVER (PARTITION BY mesh_id, x, y, z) AS rep FROM SV)"),
    "mesh_welded": _sql(
        "SELECT ST.mesh_id, row_number() OVER (PARTITION BY ST.mesh_id ORDER BY tid) - 1 AS tid, a.wid AS i0, b.wid AS i1, c.wid AS i2 FROM ST JOIN W a ON a.mesh_id = ST.mesh_id AND a.vid = i0 JOIN W b ON b.mesh_id = ST.mesh_id AND b.vid = i1 JOIN W c ON c.mesh_id = ST.mesh_id AND c.vid = i2",
        "W AS (SELECT mesh_id, vid, dense_rank() OVER (PARTITION BY mesh_id ORDER BY rep) - 1 AS wid FROM (SELECT mesh_id, vid, min(vid) OVER (PARTITION BY mesh_id, x, y, z) AS rep FROM SV))",
    ),
    "mesh_adjacency": _sql(
        "SELECT T.mesh_id, T.tid, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o), '') AS neighbours FROM T LEFT JOIN (SELECT a.mesh_id, a.tid, b.tid AS o FROM H a JOIN H b ON a.mesh_id = b.mesh_id AND a.tid <> b.tid AND least(a.src, a.dst) = least(b.src, b.dst) AND greatest(a.src, a.dst) = greatest(b.src, b.dst)) q ON q.mesh_id = T.mesh_id AND q.tid = T.tid GROUP BY 1, 2"
    ),
    "mesh_components": _sql(
        "SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY n_tri DESC, min_tid) - 1 AS region_id, n_tri, min_tid, round(area, 4) AS area FROM (SELECT L.mesh_id, label, count(*) AS n_tri, min(tid) AS min_tid, sum(len / 2) AS area FROM L JOIN LAB ON LAB.mesh_id = L.mesh_id AND node = i0 GROUP BY 1, 2)",
        _VERTEX_LINKS, True, True,
    ),
    "mesh_sub_mesh": _sql(
        "SELECT Q.mesh_id, Q.tid, a.wid AS i0, b.wid AS i1, c.wid AS i2 FROM Q JOIN W a ON a.mesh_id = Q.mesh_id AND a.v = Q.i0 JOIN W b ON b.mesh_id = Q.mesh_id AND b.v = Q.i1 JOIN W c ON c.mesh_id = Q.mesh_id AND c.v = Q.i2",
        "Q AS (SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY tid DESC) - 1 AS tid, i0, i1, i2 FROM T WHERE tid % 3 = 0), U AS (SELECT mesh_id, v, min(pos) AS pos FROM (SELECT mesh_id, unnest([i0, i1, i2]) AS v, unnest([3 * tid, 3 * tid + 1, 3 * tid + 2]) AS pos FROM Q) GROUP BY ALL), W AS (SELECT mesh_id, v, row_number() OVER (PARTITION BY mesh_id ORDER BY pos) - 1 AS wid FROM U)",
    ),
    "mesh_integrity": _sql(
        "SELECT xe.mesh_id, 0::BIGINT AS degenerate, 0::BIGINT AS duplicate, nonmanifold_edges, 0::BIGINT AS nonmanifold_vertices, boundary_edges, loops AS boundary_loops, comps AS components, vertices, edges, faces, vertices - edges + faces AS euler, NULL::BIGINT AS genus, orientable, false AS watertight FROM xe JOIN xf USING (mesh_id) JOIN xq USING (mesh_id) JOIN xl USING (mesh_id)",
        "xe AS (SELECT mesh_id, count(*) AS edges, count(*) FILTER (WHERE n_tri > 2) AS nonmanifold_edges, count(*) FILTER (WHERE n_tri = 1) AS boundary_edges, bool_and(n_tri <> 2 OR n_fwd = 1) AS orientable FROM E GROUP BY 1), xf AS (SELECT mesh_id, count(DISTINCT tid) AS faces, count(DISTINCT src) AS vertices FROM H GROUP BY 1), "
        + _VERTEX_LINKS
        + ", xq AS (SELECT mesh_id, count(DISTINCT label) AS comps FROM LAB GROUP BY 1), "
        + _REACH.format(links="SELECT mesh_id, lo AS a, hi AS b FROM E WHERE n_tri = 1 UNION ALL SELECT mesh_id, hi, lo FROM E WHERE n_tri = 1", nodes="SELECT DISTINCT mesh_id, lo AS node FROM E WHERE n_tri = 1").replace("P AS", "P2 AS").replace("\nR AS", "\nR2 AS").replace("JOIN P ", "JOIN P2 ").replace("P.", "P2.").replace("R.", "R2.").replace("FROM R ", "FROM R2 ").replace("LAB AS", "LAB2 AS")
        + ", xl AS (SELECT mesh_id, count(DISTINCT label) AS loops FROM LAB2 GROUP BY 1)",
        False, True,
    ),
    "mesh_shape_stats": _sql(
        "SELECT mesh_id, round(min(angle), 4) AS min_angle, round(min(angle) FILTER (WHERE ra - 1 = round(0.05 * (n - 1))), 4) AS p05_angle, round(max(aspect), 4) AS max_aspect, round(min(aspect) FILTER (WHERE rq - 1 = round(0.95 * (n - 1))), 4) AS p95_aspect FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY angle) ra, row_number() OVER (PARTITION BY mesh_id ORDER BY aspect) rq, count(*) OVER (PARTITION BY mesh_id) n FROM X) GROUP BY 1",
        'D AS (SELECT mesh_id, len, sqrt((cx - bx) ** 2 + (cy - "by") ** 2 + (cz - bz) ** 2) AS p, sqrt((cx - ax) ** 2 + (cy - ay) ** 2 + (cz - az) ** 2) AS q, sqrt((bx - ax) ** 2 + ("by" - ay) ** 2 + (bz - az) ** 2) AS r FROM L), X AS (SELECT mesh_id, degrees(least(acos((q * q + r * r - p * p) / (2 * q * r)), acos((p * p + r * r - q * q) / (2 * p * r)), acos((p * p + q * q - r * r) / (2 * p * q)))) AS angle, greatest(p, q, r) / (2 * sqrt(3) * (len / (p + q + r))) AS aspect FROM D)',
    ),
    "mesh_region_area": _sql("SELECT mesh_id, tid % 5 AS region_id, round(sum(len / 2), 4) AS area FROM L GROUP BY 1, 2"),
    "mesh_bounds": _sql(f"SELECT mesh_id, {_R(*((c, c) for c in ('lox', 'hix', 'loy', 'hiy', 'loz', 'hiz', 'diag', 'extent')))} FROM B"),
    "mesh_mean_edge": _sql("SELECT H.mesh_id, round(avg(sqrt((a.x::DOUBLE - b.x) ** 2 + (a.y::DOUBLE - b.y) ** 2 + (a.z::DOUBLE - b.z) ** 2)), 4) AS mean_edge FROM H JOIN V a ON a.mesh_id = H.mesh_id AND a.vid = src JOIN V b ON b.mesh_id = H.mesh_id AND b.vid = dst GROUP BY 1"),
    "mesh_winding": _sql(" UNION ALL ".join(f"SELECT mesh_id, {i}::BIGINT AS point_id, round(sum({_angle(p)}) / (4 * pi()), 4) + 0.0 AS winding FROM C GROUP BY 1" for i, p in enumerate(POINTS))),
    "mesh_slice_segments": _sql(
        "SELECT mesh_id, 0 AS plane_id, count(*) AS n, round(sum(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2 + (z1 - z2) ** 2)), 4) AS length FROM G WHERE pl = 0 GROUP BY 1 UNION ALL SELECT mesh_id, 1, count(*), round(sum(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2 + (z1 - z2) ** 2)), 4) FROM G WHERE pl = 1 GROUP BY 1",
        'D AS (SELECT 0 AS pl, (az - 9.5)::FLOAT AS da, (bz - 9.5)::FLOAT AS db, (cz - 9.5)::FLOAT AS dc, * FROM C UNION ALL SELECT 1, (ax - 10.25)::FLOAT, (bx - 10.25)::FLOAT, (cx - 10.25)::FLOAT, * FROM C), '
        "S AS (SELECT *, CASE WHEN (da >= 0) <> (db >= 0) THEN [ax + (da / (da - db))::DOUBLE * (bx - ax), ay + (da / (da - db))::DOUBLE * (\"by\" - ay), az + (da / (da - db))::DOUBLE * (bz - az)] END AS p, CASE WHEN (db >= 0) <> (dc >= 0) THEN [bx + (db / (db - dc))::DOUBLE * (cx - bx), \"by\" + (db / (db - dc))::DOUBLE * (cy - \"by\"), bz + (db / (db - dc))::DOUBLE * (cz - bz)] END AS q, CASE WHEN (dc >= 0) <> (da >= 0) THEN [cx + (dc / (dc - da))::DOUBLE * (ax - cx), cy + (dc / (dc - da))::DOUBLE * (ay - cy), cz + (dc / (dc - da))::DOUBLE * (az - cz)] END AS r FROM D WHERE NOT ((da >= 0) = (db >= 0) AND (db >= 0) = (dc >= 0))), "
        "G AS (SELECT mesh_id, pl, f[1] x1, f[2] y1, f[3] z1, g[1] x2, g[2] y2, g[3] z2 FROM (SELECT *, coalesce(p, q) AS f, CASE WHEN p IS NULL THEN r ELSE coalesce(q, r) END AS g FROM S))",
    ),
    "mesh_smooth_regions": _sql(
        "SELECT mesh_id, node AS tid, label FROM LAB",
        "J AS (SELECT p.mesh_id, p.tid AS a, q.tid AS b FROM H x JOIN H y ON x.mesh_id = y.mesh_id AND x.src = y.dst AND x.dst = y.src JOIN L p ON p.mesh_id = x.mesh_id AND p.tid = x.tid JOIN L q ON q.mesh_id = y.mesh_id AND q.tid = y.tid WHERE (p.rx * q.rx + p.ry * q.ry + p.rz * q.rz) / (p.len * q.len) >= cos(radians(3.0))), "
        + _REACH.format(links="SELECT mesh_id, a, b FROM J", nodes="SELECT mesh_id, tid AS node FROM T"),
        False, True,
    ),
    "mesh_simplify_scale": _sql("SELECT mesh_id, round(extent, 4) AS scale FROM B"),
    "mesh_vertex_quadrics": _sql(
        "SELECT mesh_id, vid, " + ", ".join(f"round(sum(w * {e}), 4) + 0.0 AS {n}" for n, e in (("qxx", "x * x"), ("qyy", "y * y"), ("qzz", "z * z"), ("qxy", "x * y"), ("qxz", "x * z"), ("qyz", "y * z"), ("qx", "x * d"), ("qy", "y * d"), ("qz", "z * d"), ("qc", "d * d"), ("qw", "1"))) + " FROM K GROUP BY 1, 2",
        _PLANES,
    ),
    "mesh_sloppy": _sql(
        "SELECT mesh_id, min(m.tid) AS tid, arg_min(a, m.tid) AS i0, arg_min(b, m.tid) AS i1, arg_min(c, m.tid) AS i2 FROM SM m WHERE a <> b AND b <> c AND a <> c GROUP BY mesh_id, list_sort([a, b, c])",
        _PLANES + ", SC AS (SELECT V.mesh_id, vid, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, " + ", ".join(_CELL.format(v=f"{c}::DOUBLE", c=c, m=11) + f" AS k{c}" for c in "xyz") + " FROM V JOIN B USING (mesh_id)), "
        "SQ AS (SELECT SC.mesh_id, kx, ky, kz, " + ", ".join(f"sum(w * {e}) AS {n}" for n, e in (("xx", "K.x * K.x"), ("yy", "K.y * K.y"), ("zz", "K.z * K.z"), ("xy", "K.x * K.y"), ("xz", "K.x * K.z"), ("yz", "K.y * K.z"), ("dx", "K.x * d"), ("dy", "K.y * d"), ("dz", "K.z * d"), ("dd", "d * d"))) + " FROM SC JOIN K USING (mesh_id, vid) GROUP BY 1, 2, 3, 4), "
        "SE AS (SELECT SC.*, abs(xx * x * x + yy * y * y + zz * z * z + 2 * (xy * x * y + xz * x * z + yz * y * z) + 2 * (dx * x + dy * y + dz * z) + dd) AS e FROM SC JOIN SQ USING (mesh_id, kx, ky, kz) WHERE (SC.mesh_id, SC.vid) IN (SELECT (mesh_id, vid) FROM K)), "
        "SB AS (SELECT mesh_id, kx, ky, kz, arg_min(vid, (round(e, 9), vid)) AS wid FROM SE GROUP BY ALL), SW AS (SELECT SC.mesh_id, vid, wid FROM SC JOIN SB USING (mesh_id, kx, ky, kz)), "
        "SM AS (SELECT T.mesh_id, tid, a.wid AS a, b.wid AS b, c.wid AS c FROM T JOIN SW a ON a.mesh_id = T.mesh_id AND a.vid = i0 JOIN SW b ON b.mesh_id = T.mesh_id AND b.vid = i1 JOIN SW c ON c.mesh_id = T.mesh_id AND c.vid = i2)",
    ),
    "mesh_vertex_kinds": _sql("SELECT * FROM KI", _KINDS, True),
    "mesh_border_quadrics": _sql(
        "SELECT mesh_id, vid, " + ", ".join(f"round(sum(10 * w * {e}), 4) + 0.0 AS {n}" for n, e in (("qxx", "x * x"), ("qyy", "y * y"), ("qzz", "z * z"), ("qxy", "x * y"), ("qxz", "x * z"), ("qyz", "y * z"), ("qx", "x * d"), ("qy", "y * d"), ("qz", "z * d"), ("qc", "d * d"), ("qw", "n"))) + " FROM (SELECT *, unnest([src, dst]) AS vid, -(x * px + y * py + z * pz) AS d FROM BW) GROUP BY 1, 2",
        _KINDS + ", PV AS (SELECT mesh_id, vid, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM V), "
        "BO AS (SELECT o.mesh_id, o.src, o.dst, h.tid, p.x AS px, p.y AS py, p.z AS pz, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz FROM OPEN o JOIN H h ON h.mesh_id = o.mesh_id AND h.src = o.src AND h.dst = o.dst "
        "JOIN PV p ON p.mesh_id = o.mesh_id AND p.vid = o.src JOIN PV q ON q.mesh_id = o.mesh_id AND q.vid = o.dst JOIN PV r ON r.mesh_id = o.mesh_id AND r.vid = h.opp JOIN KI a ON a.mesh_id = o.mesh_id AND a.vid = o.src JOIN KI b ON b.mesh_id = o.mesh_id AND b.vid = o.dst WHERE 'border' IN (a.kind, b.kind)), "
        "BU AS (SELECT *, ux * ux + uy * uy + uz * uz AS uu, ux * vx + uy * vy + uz * vz AS uv FROM BO), "
        "BN AS (SELECT mesh_id, src, dst, px, py, pz, sqrt(uu) AS w, 1 AS n, vx - ux * uv / uu AS x, vy - uy * uv / uu AS y, vz - uz * uv / uu AS z FROM BU "
        "UNION ALL SELECT mesh_id, src, dst, px, py, pz, sqrt(sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2)), 0, uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx FROM BU), "
        "BW AS (SELECT mesh_id, src, dst, px, py, pz, w, n, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM BN)",
        True,
    ),
    "mesh_vertex_remap": _sql("SELECT mesh_id, vid, dense_rank() OVER (PARTITION BY mesh_id ORDER BY g) - 1 AS wid FROM (SELECT mesh_id, vid, min(vid) OVER (PARTITION BY mesh_id, x, y, z) AS g FROM SV)"),
    "mesh_position_remap": _sql('SELECT mesh_id, vid, min(vid) OVER (PARTITION BY mesh_id, x, y, z) AS "first" FROM SV'),
    "mesh_shadow_indices": _sql(
        "SELECT ST.mesh_id, tid, a.f AS i0, b.f AS i1, c.f AS i2 FROM ST JOIN W a ON a.mesh_id = ST.mesh_id AND a.vid = i0 JOIN W b ON b.mesh_id = ST.mesh_id AND b.vid = i1 JOIN W c ON c.mesh_id = ST.mesh_id AND c.vid = i2",
        "W AS (SELECT mesh_id, vid, min(vid) OVER (PARTITION BY mesh_id, x, y, z) AS f FROM SV)",
    ),
    "mesh_adjacency_indices": _sql(
        "SELECT T.mesh_id, T.tid, i0, coalesce(a.opp, i0) AS n0, i1, coalesce(b.opp, i1) AS n1, i2, coalesce(c.opp, i2) AS n2 FROM T LEFT JOIN H a ON a.mesh_id = T.mesh_id AND a.src = i1 AND a.dst = i0 LEFT JOIN H b ON b.mesh_id = T.mesh_id AND b.src = i2 AND b.dst = i1 LEFT JOIN H c ON c.mesh_id = T.mesh_id AND c.src = i0 AND c.dst = i2"
    ),
    "mesh_quantized": _sql(
        "SELECT mesh_id, vid, u14, s8, (CASE WHEN w < 0 THEN 32768 ELSE 0 END + hb)::INT AS h, round(CASE WHEN z = 0 THEN 0 ELSE floor(z / 2.0 ** (ez - 7) + 0.5) * 2.0 ** (ez - 7) END, 4) + 0.0 AS short, round(u14 / 16383.0, 4) + 0.0 AS u, round(s8 / 127.0, 4) + 0.0 AS s, "
        "round(CASE WHEN hb < 1024 THEN 0 ELSE sign(w) * 2.0 ** (hb // 1024 - 15) * (1 + (hb % 1024) / 1024.0) END, 4) + 0.0 AS back FROM Q2",
        "Q0 AS (SELECT V.mesh_id, vid, z::DOUBLE AS z, (z - 10)::FLOAT::DOUBLE AS w, (z::DOUBLE - loz) / extent AS u FROM V JOIN B USING (mesh_id)), "
        "Q1 AS (SELECT *, floor(u * 16383 + 0.5)::INT AS u14, (sign(2 * u - 1) * floor(abs(2 * u - 1) * 127 + 0.5))::INT AS s8, CASE WHEN w <> 0 THEN floor(log2(abs(w))) END AS ew, CASE WHEN z > 0 THEN floor(log2(z)) END AS ez FROM Q0), "
        "Q2 AS (SELECT *, (CASE WHEN abs(w) < 2.0 ** -14 THEN 0 ELSE (ew + 15) * 1024 + floor(abs(w) / 2.0 ** (ew - 10) + 0.5) - 1024 END)::INT AS hb FROM Q1)",
    ),
    "mesh_octahedral": _sql(
        "SELECT mesh_id, tid, u, v, " + _R(*((f"{c} / sqrt(fx * fx + fy * fy + gz * gz)", k) for c, k in (("fx", "x"), ("fy", "y"), ("gz", "z")))) + " FROM O3",
        "O1 AS (SELECT mesh_id, tid, rz, rx / (abs(rx) + abs(ry) + abs(rz)) AS px, ry / (abs(rx) + abs(ry) + abs(rz)) AS py FROM L), "
        "O2 AS (SELECT *, CASE WHEN rz >= 0 THEN px ELSE (1 - abs(py)) * CASE WHEN px < 0 THEN -1 ELSE 1 END END AS qx, CASE WHEN rz >= 0 THEN py ELSE (1 - abs(px)) * CASE WHEN py < 0 THEN -1 ELSE 1 END END AS qy FROM O1), "
        "O25 AS (SELECT *, (CASE WHEN qx < 0 THEN -1 ELSE 1 END * floor(abs(qx) * 127 + 0.5))::INT AS u, (CASE WHEN qy < 0 THEN -1 ELSE 1 END * floor(abs(qy) * 127 + 0.5))::INT AS v FROM O2), "
        "O26 AS (SELECT *, u / 127.0 AS gx, v / 127.0 AS gy, 1 - abs(u / 127.0) - abs(v / 127.0) AS gz FROM O25), "
        "O3 AS (SELECT *, gx + CASE WHEN gx < 0 THEN -1 ELSE 1 END * least(gz, 0) AS fx, gy + CASE WHEN gy < 0 THEN -1 ELSE 1 END * least(gz, 0) AS fy FROM O26)",
    ),
    "mesh_spatial_triangles": _sql(
        "SELECT mesh_id, tid, row_number() OVER (PARTITION BY mesh_id ORDER BY m, tid) - 1 AS place FROM (SELECT mesh_id, tid, " + _MORTON.format("kx", "ky", "kz") + " AS m FROM K)",
        "K AS (SELECT C.mesh_id, tid, " + ", ".join(_CELL.format(v=f'((a{c} + {chr(34)}b{c}{chr(34)} + c{c}) / 3)', c=c, m=65535) + f" AS k{c}" for c in "xyz") + " FROM C JOIN B USING (mesh_id))",
    ),
    "mesh_pruned": _sql(
        "SELECT T.mesh_id, T.tid, i0, i1, i2 FROM T JOIN LAB ON LAB.mesh_id = T.mesh_id AND LAB.node = T.i0 JOIN KEEP ON KEEP.mesh_id = LAB.mesh_id AND KEEP.label = LAB.label",
        _VERTEX_LINKS + ", PV AS (SELECT LAB.mesh_id, label, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM LAB JOIN V ON V.mesh_id = LAB.mesh_id AND V.vid = LAB.node), "
        "PM AS (SELECT mesh_id, label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM PV GROUP BY ALL), "
        "KEEP AS (SELECT PV.mesh_id, PV.label FROM PV JOIN PM ON PM.mesh_id = PV.mesh_id AND PM.label = PV.label JOIN B ON B.mesh_id = PV.mesh_id GROUP BY PV.mesh_id, PV.label, extent HAVING max((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) > (0.05 * extent) ** 2)",
        True, True,
    ),
    "mesh_tessellation_indices": _sql(
        "SELECT mesh_id, tid, " + ", ".join(f"max({c}) FILTER (WHERE k = {k}) AS {n}" for k in range(3) for c, n in (("src", f"i{k}"), ("oa", f"o{k}a"), ("ob", f"o{k}b"), ("sa", f"d{k}"))) + " FROM G2 GROUP BY 1, 2",
        "W AS (SELECT mesh_id, vid, min(vid) OVER (PARTITION BY mesh_id, x, y, z) AS f FROM SV), "
        "HS AS (SELECT mesh_id, tid, 0 AS k, i0 AS src, i1 AS dst FROM ST UNION ALL SELECT mesh_id, tid, 1, i1, i2 FROM ST UNION ALL SELECT mesh_id, tid, 2, i2, i0 FROM ST), "
        "G AS (SELECT HS.*, a.f AS sa, b.f AS da FROM HS JOIN W a ON a.mesh_id = HS.mesh_id AND a.vid = src JOIN W b ON b.mesh_id = HS.mesh_id AND b.vid = dst), "
        "G2 AS (SELECT g.*, coalesce(arg_min(o.dst, 3 * o.tid + o.k), any_value(g.src)) AS oa, coalesce(arg_min(o.src, 3 * o.tid + o.k), any_value(g.dst)) AS ob FROM G g LEFT JOIN G o ON o.mesh_id = g.mesh_id AND o.sa = g.da AND o.da = g.sa GROUP BY ALL)",
    ),
    # a cache that holds every vertex transforms each once
    "mesh_vertex_cache": _sql("SELECT mesh_id, count(DISTINCT src) AS transformed, 1::BIGINT AS warps, round(count(DISTINCT src) / count(DISTINCT tid), 4) AS acmr, 1.0::DOUBLE AS atvr FROM H GROUP BY 1"),
    "mesh_vertex_fetch": _sql(
        "SELECT mesh_id, bytes_fetched, round(bytes_fetched / (n * 40), 4) AS overfetch FROM (SELECT mesh_id, sum(f)::BIGINT * 64 AS bytes_fetched FROM R GROUP BY 1) JOIN (SELECT mesh_id, count(DISTINCT src) AS n FROM H GROUP BY 1) USING (mesh_id)",
        "A AS (SELECT mesh_id, 3 * tid + k AS pos, unnest(range(src * 40 // 64, (src * 40 + 39) // 64 + 1)) AS line FROM H), "
        "R AS (SELECT mesh_id, CASE WHEN lag(line) OVER (PARTITION BY mesh_id, line % 2048 ORDER BY pos, line) IS NOT DISTINCT FROM line THEN 0 ELSE 1 END AS f FROM A)",
    ),
    "mesh_meshlet_indices": _sql(
        "SELECT U.mesh_id, U.meshlet_id, U.tid, " + ", ".join(f"max(l) FILTER (WHERE k = {k}) AS l{k}" for k in range(3)) + ", any_value(n) AS n_vertices FROM U JOIN LO USING (mesh_id, meshlet_id, vid) GROUP BY 1, 2, 3",
        "U AS (SELECT mesh_id, tid // 48 AS meshlet_id, tid, k, src AS vid FROM H), FU AS (SELECT mesh_id, meshlet_id, vid, min(3 * tid + k) AS pos FROM U GROUP BY ALL), "
        "LO AS (SELECT mesh_id, meshlet_id, vid, row_number() OVER (PARTITION BY mesh_id, meshlet_id ORDER BY pos) - 1 AS l, count(*) OVER (PARTITION BY mesh_id, meshlet_id) AS n FROM FU)",
    ),
    # runs that only the count of triangles ends
    "mesh_scanned_meshlets": _sql("SELECT mesh_id, row // 32 AS meshlet_id, row AS tid, i0, i1, i2 FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY tid) - 1 AS row FROM T)"),
    "mesh_strips": _sql(f"SELECT mesh_id, {_LEAST_FIRST} FROM T"),
    "mesh_provoking": _sql(f"SELECT mesh_id, row AS tid, row AS i0, {_LEAST_FIRST} FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY tid) - 1 AS row FROM T)"),
    "mesh_quaternions": _sql(
        "SELECT mesh_id, vid, d0, d1, d2, d3, " + ", ".join(f"(sign(o[{k} - place + 1 + CASE WHEN place > {k} THEN 4 ELSE 0 END]) * floor(abs(o[{k} - place + 1 + CASE WHEN place > {k} THEN 4 ELSE 0 END]) * (32767 / sqrt(2.0::DOUBLE)) / 2047 + 0.5))::INT AS b{k}" for k in range(4)) + " FROM QD",
        "QA AS (SELECT mesh_id, vid, x::DOUBLE - 15.5 AS a, y::DOUBLE - 2.25 AS b, z::DOUBLE - 10.125 AS c, -6.0::DOUBLE AS d FROM V), "
        "QB AS (SELECT mesh_id, vid, [a / s, b / s, c / s, d / s] AS q FROM (SELECT *, sqrt(a * a + b * b + c * c + 36.0) AS s FROM QA)), "
        "QP AS (SELECT *, list_position([abs(e) for e in q], greatest(abs(q[1]), abs(q[2]), abs(q[3]), abs(q[4]))) - 1 AS place FROM QB), "
        "QC AS (SELECT mesh_id, vid, place, " + ", ".join(f"q[(place + {k}) % 4 + 1] * sqrt(2.0::DOUBLE) * sign(q[place + 1]) AS v{k}" for k in (1, 2, 3)) + " FROM QP), "
        "QE AS (SELECT mesh_id, vid, place, " + ", ".join(f"(sign(v{k + 1}) * floor(least(1, abs(v{k + 1})) * 2047 + 0.5))::INT AS d{k}" for k in range(3)) + ", (2044 + place)::INT AS d3 FROM QC), "
        "QD AS (SELECT *, [sqrt(2 * 2047 ** 2 - d0 * d0 - d1 * d1 - d2 * d2), d0, d1, d2] AS o FROM QE)",
    ),
    "mesh_exponentials": _sql(
        "SELECT mesh_id, vid, " + ", ".join(f"(((p{k} - 11) & 255)::BIGINT * 16777216 + m{k} - CASE WHEN p{k} < 11 THEN 4294967296 ELSE 0 END + CASE WHEN m{k} < 0 THEN 16777216 ELSE 0 END)::INT AS {k}, round(m{k} * 2.0 ** (p{k} - 11), 4) + 0.0 AS {k}_back" for k in ("own", "vector", "component", "clamped")) + " FROM XM",
        "XV AS (SELECT mesh_id, vid, x::DOUBLE - 7.25 AS x, y::DOUBLE - 2.5 AS y, z::DOUBLE - 10.125 AS z FROM V), "
        "XP AS (SELECT *, " + ", ".join(f"CASE WHEN {c} = 0 THEN 0 ELSE floor(log2(abs({c})))::INT + 1 END AS e{c}" for c in "xyz") + " FROM XV), "
        "XS AS (SELECT mesh_id, vid, z, ez AS pown, greatest(ex, ey, ez) AS pvector, max(ez) OVER (PARTITION BY mesh_id) AS pcomponent, greatest(ez, 0) AS pclamped FROM XP), "
        "XM AS (SELECT *, " + ", ".join(f"(sign(z) * floor(abs(z) * 2.0 ** (11 - p{k}) + 0.5))::BIGINT AS m{k}" for k in ("own", "vector", "component", "clamped")) + " FROM XS)",
    ),
    "mesh_colors": _sql(
        "SELECT mesh_id, vid, luma, orange, lime, alpha, luma + orange - lime AS r, luma + lime AS g, luma - orange - lime AS b, ((alpha * 2) & 255) | (alpha & 1) AS a FROM CB",
        "CU AS (SELECT mesh_id, vid, (x::DOUBLE - lox) / extent AS x, (y::DOUBLE - loy) / extent AS y, (z::DOUBLE - loz) / extent AS z FROM V JOIN B USING (mesh_id)), "
        "CI AS (SELECT mesh_id, vid, floor(x * 255 + 0.5)::INT AS r, floor(y * 255 + 0.5)::INT AS g, floor(z * 255 + 0.5)::INT AS b, 128 + floor((x + y) / 2 * 255 + 0.5)::INT // 2 AS alpha FROM CU), "
        "CO AS (SELECT *, trunc((r - b) / 2)::INT AS orange FROM CI), "
        "CB AS (SELECT *, b + orange + trunc((g - b - orange) / 2)::INT AS luma, trunc((g - b - orange) / 2)::INT AS lime FROM CO)",
    ),
    "mesh_fetch_order": _sql("SELECT mesh_id, vid, row_number() OVER (PARTITION BY mesh_id ORDER BY pos) - 1 AS wid FROM (SELECT mesh_id, src AS vid, min(3 * tid + k) AS pos FROM H GROUP BY ALL)"),
    "mesh_spatial_order": _sql(
        "SELECT mesh_id, vid, row_number() OVER (PARTITION BY mesh_id ORDER BY m, vid) - 1 AS place FROM (SELECT mesh_id, vid, " + _MORTON.format("kx", "ky", "kz") + " AS m FROM K)",
        "K AS (SELECT V.mesh_id, vid, " + ", ".join(_CELL.format(v=f"{c}::DOUBLE", c=c, m=65535) + f" AS k{c}" for c in "xyz") + " FROM V JOIN B USING (mesh_id))",
    ),
    "mesh_clustered_points": _sql(
        "SELECT mesh_id, vid FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, kx, ky, kz ORDER BY round((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2, 9), vid) AS r FROM M) WHERE r = 1",
        "K AS (SELECT V.mesh_id, vid, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, " + ", ".join(_CELL.format(v=f"{c}::DOUBLE", c=c, m=11) + f" AS k{c}" for c in "xyz") + " FROM V JOIN B USING (mesh_id)), M AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM K WINDOW w AS (PARTITION BY mesh_id, kx, ky, kz))",
    ),
}


def _on_orders(sql: str) -> str:
    """The SQL of a query over parts, over the meshes of orders."""
    return (
        sql
        .replace("p_partkey", "o_orderkey")
        .replace("p_retailprice / 100", "o_totalprice / 20000")
        .replace("FROM part)", "FROM orders)")
        .replace("% 200", "% 15000")
        .replace("// 200 ", "// 15000 ")
        .replace("o_orderkey % 40", "o_orderkey % 100")
        .replace("//40", "// 100")
        .replace("// 40)", "// 100)")
        .replace("vid + 41", "vid + 101")
        .replace("vid + 40", "vid + 100")
        .replace("a.x < 39", "a.x < 99")
    )


SQL["mesh_summary_orders"] = _on_orders(SQL["mesh_summary"])
# inner collapses take two triangles each; with its border kept, what a mesh covers of the ground stays
SQL["mesh_simplified_orders"] = _on_orders(
    _sql('SELECT mesh_id, count(*) AS before, count(*) - 2 * ceil((count(*) - round_even(count(*) / 2, 0)) / 2)::BIGINT AS after, round(sum(rz) / 2, 3) AS ground FROM L GROUP BY 1')
)
QUERIES |= shapes.QUERIES
SQL |= shapes.SQL
