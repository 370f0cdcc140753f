"""Mesh operators on shapes whose answers are worked out by hand: octahedra, wedges, fans, rings of rings and a saddle."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import quantize
from tessera.functions.vec import fibonacci_directions
from tessera.model import TRIANGLES, VERTICES, Mesh, corners
from tessera.operators import alignment, analysis, curvature, decimation, fitting, foundations, rendering, segmentation, slicing, winding
from tessera.sources import lathes

#: Corners at distance 2 on the axes; every face joins one corner of each axis. Edges 2 * sqrt(2), faces 2 * sqrt(3).
OCTA_P = [(2 * s if k == 0 else 0, 2 * s if k == 1 else 0, 2 * s if k == 2 else 0) for k in range(3) for s in (1, -1)]
OCTA_T = [((a, 2 + b, 4 + c) if (a + b + c) % 2 == 0 else (a, 4 + c, 2 + b)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
#: A wedge of height 5 over the right triangle with legs 3 and 4.
WEDGE_P = [(x, y, z) for z in (0, 5) for x, y in ((0, 0), (3, 0), (0, 4))]
WEDGE_T = [(0, 2, 1), (3, 4, 5), (0, 1, 4), (4, 3, 0), (1, 2, 5), (5, 4, 1), (2, 0, 3), (3, 5, 2)]


def mesh(spark, *shapes):
    """Shapes (points, triangles) as meshes 0, 1, .."""
    v = [(m, i, *map(float, p)) for m, (ps, _) in enumerate(shapes) for i, p in enumerate(ps)]
    t = [(m, i, *map(int, x)) for m, (_, ts) in enumerate(shapes) for i, x in enumerate(ts)]
    return Mesh(spark.createDataFrame(v, VERTICES), spark.createDataFrame(t, TRIANGLES))


def ring_of_rings(big, small, around, across):
    """A closed ring surface: the point at angles a and b is (big + small * cos b) * (cos a, sin a), small * sin b."""
    p = [((big + small * math.cos(b)) * math.cos(a), (big + small * math.cos(b)) * math.sin(a), small * math.sin(b)) for a in np.arange(around) * math.tau / around for b in np.arange(across) * math.tau / across]
    at = lambda i, j: i % around * across + j % across
    return p, [x for i in range(around) for j in range(across) for x in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i, j + 1), at(i + 1, j), at(i + 1, j + 1)))]


def tube(radius, height, around, rings):
    """The open side of a tube; diagonals alternate."""
    p = np.array([(radius * math.sin(a), radius * -math.cos(a), z) for z in np.linspace(0, height, rings) for a in np.arange(around) * math.tau / around])
    t = []
    for i in range(rings - 1):
        for j in range(around):
            lower, upper = (i * around + j, i * around + (j + 1) % around), ((i + 1) * around + j, (i + 1) * around + (j + 1) % around)
            cut = ((*lower, upper[j % 2]), (lower[1 - j % 2], upper[1], upper[0]))
            t += cut
    return p, np.array(t)


def test_weld_of_loose_triangles(spark):
    loose = [OCTA_P[i] for t in OCTA_T for i in t], np.arange(24).reshape(8, 3)
    m = foundations.welded(mesh(spark, loose))
    assert (m.vertices.count(), m.triangles.count()) == (6, 8)
    assert abs(sum(x.area for x in foundations.areas(m).collect()) - 16 * math.sqrt(3)) < 1e-5


def test_integrity(spark):
    fan = [(0, 0, 0), (0, 0, 3)] + [(math.cos(a), math.sin(a), 1.5) for a in (0, 2, 4)], [(0, 1, 2), (0, 1, 3), (0, 1, 4)]
    far = [(x + 4, y, z) for x, y, z in OCTA_P]  # its corner at -2 is the other's at 2
    touching = OCTA_P + [q for i, q in enumerate(far) if i != 1], OCTA_T + [tuple(0 if i == 1 else 6 + i - (i > 1) for i in t) for t in OCTA_T]
    turned = OCTA_P, [OCTA_T[0][::-1], *OCTA_T[1:]]
    spoiled = [*OCTA_P, (9, 9, 9)], [*OCTA_T, (0, 0, 6), OCTA_T[3][1:] + OCTA_T[3][:1]]
    r = {x.mesh_id: x for x in foundations.integrity_report(mesh(spark, (OCTA_P, OCTA_T), ring_of_rings(7, 2, 9, 6), fan, touching, turned, spoiled)).collect()}
    assert (r[0].watertight, r[0].vertices, r[0].edges, r[0].faces, r[0].euler, r[0].genus, r[0].components) == (True, 6, 12, 8, 2, 0, 1)
    assert (r[1].watertight, r[1].euler, r[1].genus, r[1].boundary_edges) == (True, 0, 1, 0)
    assert (r[2].nonmanifold_edges, r[2].boundary_edges, r[2].watertight) == (1, 6, False)
    assert (r[3].nonmanifold_vertices, r[3].nonmanifold_edges, r[3].components) == (1, 0, 1)
    assert not r[4].orientable and (r[5].degenerate, r[5].duplicate) == (1, 1)


def test_neighbours_of_an_octahedron(spark):
    got = {x.tid: x.neighbours for x in foundations.triangle_adjacency(mesh(spark, (OCTA_P, OCTA_T))).collect()}
    # face number abc in binary: neighbours differ in one axis
    assert got == {k: sorted(k ^ b for b in (1, 2, 4)) for k in range(8)}


def test_winding_and_orientation(spark):
    m = mesh(spark, (OCTA_P, OCTA_T), (OCTA_P, [t[::-1] for t in OCTA_T]))
    pts = spark.createDataFrame([(k, i, *p) for k in (0, 1) for i, p in enumerate([(0.3, 0.2, -0.1), (1.5, 1.5, 0.0)])], "mesh_id long, point_id long, px double, py double, pz double")
    got = {(x.mesh_id, x.point_id): round(x.winding, 5) for x in winding.winding_number(m, pts).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): -1.0, (1, 1): 0.0}
    p, t = tube(2.0, 6.0, 12, 4)  # open: outside, the closed ones wind around nothing either way
    assert {x.mesh_id: x.looks_inverted for x in winding.orientation_report(mesh(spark, (p, t), (p, t[:, ::-1]))).collect()} == {0: False, 1: True}
    assert len(fibonacci_directions(1)) == 1


def test_sections_of_a_wedge(spark):
    got = slicing.cross_sections(mesh(spark, (WEDGE_P, WEDGE_T)), [slicing.CutPlane((0, 0, 2), (0, 0, 1)), slicing.CutPlane((0, 1, 0), (0, 1, 0))]).collect()
    a, b = sorted(got, key=lambda x: x.plane_id)
    assert a.closed and not a.is_hole and abs(a.signed_area - 6) < 1e-5 and abs(a.perimeter - 12) < 1e-5
    assert abs(b.signed_area - 2.25 * 5) < 1e-5  # the triangle is 3 * (1 - 1 / 4) wide there


def test_stacks_follow_each_mesh(spark):
    high = [(x, y, z + 100) for x, y, z in WEDGE_P]
    m = mesh(spark, (WEDGE_P, WEDGE_T), (high, WEDGE_T))
    got = sorted((x.mesh_id, x.plane_id, round(x.offset, 5), round(x.signed_area, 4)) for x in slicing.stacked_sections(m, (0, 0, 3), 2.0, (0, 0, 1)).collect())
    assert got == [(k, i, 100 * k + 2 * i, 6.0) for k in (0, 1) for i in (0, 1, 2) if 2 * i <= 3]
    assert slicing.stacked_sections(m, (0, 0, 1), 0.0).count() == slicing.stacked_sections(m, (0, 0, 1), 50.0).count() == 0
    ring = mesh(spark, ring_of_rings(7, 2, 24, 16))
    cut = sorted((x.is_hole, x.depth) for x in slicing.stacked_sections(ring, (0, 0, 1), 9.0, margin=2.0).collect())
    assert cut == [(False, 0), (True, 1)]


def test_creases(spark):
    m = mesh(spark, (OCTA_P, OCTA_T), (WEDGE_P, WEDGE_T))
    got = curvature.crease_edges(m).collect()
    assert sum(x.mesh_id == 0 for x in got) == 12 and all(abs(x.angle - math.degrees(math.acos(1 / 3))) < 1e-3 for x in got if x.mesh_id == 0)
    assert sorted(round(x.angle, 2) for x in got if x.mesh_id == 1) == sorted([90.0] * 6 + [round(180 - math.degrees(a), 2) for a in (math.pi / 2, math.atan(4 / 3), math.atan(3 / 4))])


def test_curvature_slippage_and_fit_of_a_tube():
    p, t = tube(4.0, 15.0, 30, 9)
    k = curvature.vertex_curvatures(p, t)[60:-60]
    assert np.allclose(np.abs(k[:, 0]), 0.25, rtol=0.05) and np.allclose(k[:, 1], 0, atol=1e-6)
    assert curvature.slippage(p, t)["kind"] == "cylinder"
    regions, fits, left, _ = segmentation.segment(p, t, segmentation.SegmentOptions())
    assert len(regions) == 1 and fits[0].kind == "cylinder" and abs(fits[0].params[6] - 4) < 1e-6 and left == 0
    regions, fits, left = segmentation.ransac(p, t, segmentation.RansacOptions())
    assert sum(map(len, regions)) + left == len(t) and fits[0].kind == "cylinder"


def test_faces_of_an_octahedron_are_planes():
    regions, fits, left, _ = segmentation.segment(np.array(OCTA_P, float), np.array(OCTA_T), segmentation.SegmentOptions())
    assert sorted(map(len, regions)) == [1] * 8 and left == 0 and {f.kind for f in fits} == {"plane"}


def test_alignment_recovers_a_motion():
    u, v = (x.reshape(-1).astype(float) for x in np.meshgrid(np.arange(18), np.arange(13)))
    g = np.stack((u, v + 0.5 * (u % 2), 0.06 * (u - 7) * (v - 4) + 0.4 * np.abs(np.sin(u / 2))), 1)
    a = (np.arange(12)[:, None] * 18 + np.arange(17)).reshape(-1)
    t = np.concatenate((np.stack((a, a + 1, a + 18), 1), np.stack((a + 1, a + 19, a + 18), 1)))
    q = alignment.rodrigues(np.array([-0.07, 0.16, 0.12]))
    got = alignment.align(g @ q.T + [-0.8, 0.4, 0.6], t, g, t)
    m = np.array(got["transform"]).reshape(4, 4).T
    assert got["residual_rms"] < 0.05 and np.allclose(m[:3, :3] @ q, np.eye(3), atol=1e-3)


def test_samples_go_round_the_directions():
    n = np.array([(0, 0, 1.0)] * 50 + [(0, 0, -1.0), (1.0, 0, 0), (0, 1.0, 0)])
    assert sorted(alignment.normal_space_sample(n, 4).tolist()) == [0, 50, 51, 52]
    assert alignment.normal_space_sample(n, 4).tolist()[0] == 50  # lowest latitude first


def test_decimation_bounds_and_options():
    p, t = tube(4.0, 15.0, 30, 9)
    out, error = decimation.simplify(p, t, decimation.SimplifyOptions(target_reduction=0.5, preserve_boundary=False))
    assert 0 < len(out) <= len(t) // 2 and 0 <= error < 0.5
    for bad in ({}, {"target_triangles": 0}):
        with pytest.raises(ValueError):
            decimation.SimplifyOptions(**bad)


def ring(around, across):
    p, t = ring_of_rings(3.0, 1.0, around, across)
    return np.array(p), np.array(t)


def edge_counts(t):
    e = np.sort(t[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2), 1)
    return np.unique(e, axis=0, return_counts=True)


def test_decimation_keeps_closed_meshes_closed():
    p, t = ring(60, 24)
    volume = lambda t: np.einsum("ij,ij->i", p[t[:, 0]], np.cross(p[t[:, 1]], p[t[:, 2]])).sum() / 6
    for goal in (2000, 700, 150):
        out, error = decimation.simplify(p, t, decimation.SimplifyOptions(target_triangles=goal))
        e, n = edge_counts(out)
        assert len(out) == goal and (n == 2).all() and len(np.unique(out)) - len(e) + len(out) == 0  # a torus still
        assert abs(volume(out) / volume(t) - 1) < 60 / goal and error < 0.4
    capped, error = decimation.simplify(p, t, decimation.SimplifyOptions(target_triangles=10, error_cap=0.02))
    assert error <= 0.02 and 10 < len(capped) < 2000
    split = np.repeat(p, 2, 0)  # every place twice: halves of the triangles on the other vertex
    twice, _ = decimation.simplify(split, np.where(np.arange(len(t))[:, None] % 2, 2 * t + 1, 2 * t), decimation.SimplifyOptions(target_triangles=700))
    assert len(twice) == 700 and (edge_counts(twice)[1] == 2).all()


def test_decimation_of_borders(spark):
    p, t = tube(4.0, 15.0, 30, 9)
    m = mesh(spark, (p, t))
    kinds = {x.vid: x.kind for x in decimation.vertex_kinds(m).collect()}
    e, n = edge_counts(t)
    rim = set(np.unique(e[n == 1]).tolist())
    assert rim and all(kinds[v] == ("border" if v in rim else "manifold") for v in kinds)
    assert rim == {x.vid for x in decimation.border_quadrics(m).collect()}
    held, _ = decimation.simplify(p, t, decimation.SimplifyOptions(target_triangles=80))
    assert rim <= set(held.reshape(-1).tolist())
    free, _ = decimation.simplify(p, t, decimation.SimplifyOptions(target_triangles=30, preserve_boundary=False))
    e, n = edge_counts(free)
    assert len(free) <= 30 and set(np.unique(e[n == 1]).tolist()) < rim  # they moved along the rims only
    q = decimation._quadrics(p, t, decimation._kinds(t, len(p)))
    faces = {x.vid: x for x in decimation.vertex_quadrics(m).collect()}
    border = {x.vid: x for x in decimation.border_quadrics(m).collect()}
    names = ("qxx", "qyy", "qzz", "qxy", "qxz", "qyz", "qx", "qy", "qz", "qc", "qw")
    for v in faces:
        both = [faces[v][k] + (border[v][k] if v in border else 0) for k in names]
        assert np.allclose(both, q[v], rtol=1e-4, atol=1e-3)


def test_shapes_of_the_queries_are_closed_around(spark):
    of = spark.createDataFrame([(5, 3, 2.0, 6.0)], "mesh_id long, kind int, r double, h double")
    m = lathes.lathes(of)
    r = foundations.integrity_report(m).first()
    assert (r.vertices, r.faces, r.boundary_edges, r.boundary_loops, r.orientable) == (168, 288, 48, 2, True)
    assert abs(sum(x.area for x in foundations.areas(m).collect()) - 72) < 1e-3


def test_quantisation(spark):
    values = [0.0, 1.0, -2.5, 65504.0, 65520.0, 70000.0, 6.2e-5, 6.0e-5, 1 / 3, 2.0**-14, float("inf"), 1.0009765, 1.0004882, 2047.5]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v float")
    got = rows.select("i", "v", quantize.half(rows.v).alias("h"), quantize.shortened(rows.v, 4).alias("s"), quantize.unorm(rows.v, 8).alias("u"), quantize.snorm(rows.v, 8).alias("n"))
    got = sorted(got.select("*", quantize.from_half(got.h).alias("back")).collect())
    for x in got:
        exact = struct.unpack("<H", struct.pack("<e", x.v))[0] if abs(x.v) < 65520 else 0x7C00
        assert x.h == (exact if abs(x.v) >= 2.0**-14 else 0), x
        assert x.back == (struct.unpack("<e", struct.pack("<H", x.h))[0])
        assert x.u == int(min(1, max(0, x.v)) * 255 + 0.5) and x.n == math.copysign(int(abs(min(1, max(-1, x.v))) * 127 + 0.5), x.v)
    assert [x.s for x in got][2] == -2.5 and abs(got[8].s - 0.328125) < 1e-9  # 1 / 3 with four bits behind the first
    d = fibonacci_directions(64)
    df = spark.createDataFrame([tuple(map(float, x)) for x in d], "x double, y double, z double")
    u, v = quantize.octahedral(df.x, df.y, df.z, 12)
    df = df.select("*", u.alias("u"), v.alias("v"))
    x, y, z = quantize.from_octahedral(df.u, df.v, 12)
    assert df.select(((x - df.x) ** 2 + (y - df.y) ** 2 + (z - df.z) ** 2).alias("e")).where("e > 1e-5").count() == 0


def test_empty_mesh(spark):
    m = Mesh(spark.createDataFrame([], VERTICES), spark.createDataFrame([], TRIANGLES))
    assert foundations.face_normals(m).count() == foundations.welded(m).triangles.count() == 0
    assert slicing.stacked_sections(m, (1, 0, 0), 1.0).count() == 0
    assert fitting.fit_plane(np.zeros((2, 3))) is None


def test_vertex_cache_and_meshlets(spark):
    p, t = tube(2.0, 6.0, 12, 6)
    m = mesh(spark, (p, t))

    def fifo(size, warp):
        held, done, new, warps = [], 0, 0, 0
        for row in t.tolist():
            if warp and new + sum(v not in held for v in row) > warp:
                held, new, warps = [], 0, warps + 1
            for v in row:
                if v not in held:
                    held, done, new = (held + [v])[-size:], done + 1, new + 1
        return done, warps + 1

    for size, warp in ((3, 0), (8, 0), (16, 0), (100, 0), (16, 9)):
        x = analysis.vertex_cache(m, size, warp).first()
        assert (x.transformed, x.warps) == fifo(size, warp) and abs(x.acmr - x.transformed / len(t)) < 1e-9
    assert analysis.vertex_cache(m, 100).first().atvr == 1.0
    runs = analysis.scanned_meshlets(m, 10, 7)
    local = analysis.meshlet_indices(runs).collect()
    by = {}
    for x in runs.collect():
        by.setdefault(x.meshlet_id, []).append(x)
    sizes = {x.meshlet_id: x.n_vertices for x in local}
    for k, rows in by.items():
        used = {v for x in rows for v in (x.i0, x.i1, x.i2)}
        assert len(rows) <= 7 and len(used) <= 10 and sizes[k] == len(used)
        if k + 1 in by:  # the next triangle didn't fit
            nxt = min(by[k + 1], key=lambda x: x.tid)
            assert len(rows) == 7 or len(used | {nxt.i0, nxt.i1, nxt.i2}) > 10
    with pytest.raises(ValueError):
        analysis.scanned_meshlets(m, 2)


def test_strips_and_provoking_indices(spark):
    p, t = ring(12, 7)
    t = np.concatenate((t, [[3, 3, 9]]))  # one triangle that is none
    m = mesh(spark, (p, t))
    turned = lambda rows: sorted(tuple(r[k:] + r[:k]) for r in rows for k in [r.index(min(r))])
    strip = rendering.strips(m)
    back = [[x.i0, x.i1, x.i2] for x in rendering.unstripped(strip).collect()]
    assert turned(back) == turned(t[:-1].tolist())
    assert strip.count() < 2.2 * len(t)  # three places a triangle without strips
    rows = sorted(rendering.provoking_indices(m).collect(), key=lambda x: x.tid)
    assert [x.i0 for x in rows] == list(range(len(t)))
    assert turned([[x.v0, x.v1, x.v2] for x in rows]) == turned(t.tolist())
    table = {(x[f"i{k}"], x[f"v{k}"]) for x in rows for k in range(3)}
    assert sorted(i for i, _ in table) == list(range(len(table)))  # each index stands for one vertex, without gaps


def test_cache_order_serves_the_cache_better(spark):
    p, t = ring(24, 18)
    t = t[np.random.default_rng(3).permutation(len(t))]
    before = analysis.vertex_cache(mesh(spark, (p, t))).first()
    order = [x.tid for x in rendering.cache_order(mesh(spark, (p, t))).orderBy("place").collect()]
    assert sorted(order) == list(range(len(t)))
    after = analysis.vertex_cache(mesh(spark, (p, t[order]))).first()
    assert after.acmr < 0.85 < 2 < before.acmr


def test_bounds_of_clusters_and_spheres(spark):
    p, t = ring(10, 6)
    m = mesh(spark, (p, t))
    patches = corners(m).withColumn("meshlet_id", F.col("tid") % 5)
    for x in rendering.cluster_bounds(patches.where("meshlet_id < 2")).collect() + rendering.cluster_bounds(patches.withColumn("meshlet_id", F.col("tid"))).collect():
        rows = [f for f in range(len(t)) if (f % 5 == x.meshlet_id if x.cutoff == 1 else f == x.meshlet_id)]
        far = max(np.linalg.norm(p[v] - (x.x, x.y, x.z)) for f in rows for v in t[f])
        assert far <= x.radius + 1e-5
        for f in rows if x.cutoff < 1 else []:
            n = np.cross(p[t[f][1]] - p[t[f][0]], p[t[f][2]] - p[t[f][0]])
            assert n @ (x.axis_x, x.axis_y, x.axis_z) / np.linalg.norm(n) > 1 - 1e-4 and x.s8_cutoff >= 127 * x.cutoff
            assert n @ (np.array((x.apex_x, x.apex_y, x.apex_z)) - p[t[f][0]]) < 1e-4
    balls = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (1, 5.0, 0.0, 0.0, 2.0), (1, 2.0, 0.5, 0.0, None), (2, None, 0.0, 0.0, 1.0), (3, 1.0, 2.0, 3.0, 0.0)], "mesh_id long, x double, y double, z double, radius double")
    got = {b.mesh_id: b for b in rendering.sphere_bounds(balls).collect()}
    assert set(got) == {1, 3} and (got[1].x, got[1].radius, got[3].radius) == (3.0, 4.0, 0.0)


def test_vertex_filters(spark):
    rng = np.random.default_rng(5)
    q = rng.normal(size=(60, 4))
    q = np.concatenate((q / np.linalg.norm(q, axis=1, keepdims=True), [[0.5, 0.5, 0.5, 0.5], [-1, 0, 0, 0], [0, 0, -1, 0]]))
    df = spark.createDataFrame([tuple(map(float, r)) for r in q], "a double, b double, c double, d double")
    codes = df.select("*", *(c.alias(f"e{k}") for k, c in enumerate(quantize.quaternion((df.a, df.b, df.c, df.d), 12))))
    for r in codes.select("*", *(c.alias(f"f{k}") for k, c in enumerate(quantize.from_quaternion(tuple(F.col(f"e{k}") for k in range(4)))))).collect():
        one, other = np.array(r[:4]), np.array(r[8:]) / 32767
        assert min(abs(one - other).max(), abs(one + other).max()) < 1e-3 and r.e3 % 4 == int(np.abs(one).argmax())
    v = [0.0, 1.0, -1.0, 0.3, -2.75, 1000.0, 1e-9, -65535.5, 8.0, 3.4e5]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for bits in (8, 15, 24):
        for r in df.select("v", quantize.from_exponential(quantize.exponential(F.col("v"), quantize.power(F.col("v")), bits)).alias("w")).collect():
            assert abs(r.v - r.w) <= abs(r.v) * 2.0 ** (1 - bits)
    c = rng.random((80, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in [*c, (0, 0, 0, 0), (1, 1, 1, 1), (0, 1, 0, 1)]], "r double, g double, b double, a double")
    codes = df.select("*", *(k.alias(n) for k, n in zip(quantize.color(df.r, df.g, df.b, df.a, 8), "yuvw")))
    for r in codes.select("*", *(k.alias("o" + n) for k, n in zip(quantize.from_color(*(F.col(n) for n in "yuvw")), "rgba"))).collect():
        # the halved differences lose a bit each, alpha its lowest
        assert all(abs(r["o" + n] - int(r[n] * 255 + 0.5)) <= 1 for n in "rgb") and abs(r.oa - r.a * 255) <= 1.6


JOINED = "welded crease_edges crease_rings cross_sections orientation shadow_indices tessellation_indices vertex_remap section_stack aligned adjacency region_area"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.range(12).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{at}/supplier.parquet")
    spark.range(600).selectExpr("id AS p_partkey", "900D + (id * 37) % 101 AS p_retailprice").coalesce(1).write.parquet(f"{at}/part.parquet")
    return at


@pytest.mark.parametrize("name", JOINED.split())
def test_joins_gather_no_table_on_the_driver(spark, tables, name):
    import __spark_entry__

    plan = __spark_entry__.queries()["mesh_" + name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rounds_of_labels_gather_no_table_on_the_driver(spark, monkeypatch):
    from tessera.operators import graph

    plans, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    segmentation.smooth_regions(mesh(spark, (OCTA_P, OCTA_T)), 80.0).collect()
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_a_small_file_of_shapes_is_dealt_to_all_cores(spark, tables):
    from tessera.sources import heightfields

    for m in (lathes.lathes(lathes.shapes(spark, tables)), heightfields.parts(spark, tables)):
        assert m.vertices.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", "boundary_loops cluster_bounds region_area adjacency crease_edges".split())
def test_tasks_hold_no_more_meshes_when_there_are_more(spark, tables, monkeypatch, name):
    import __spark_entry__
    from tessera import model

    monkeypatch.setattr(model, "FILL", 20)
    plan = __spark_entry__.queries()["mesh_" + name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    n = math.ceil({"boundary_loops": 12 * 168, "cluster_bounds": 3 * 168, "crease_edges": 12 * 168}.get(name, 600) / 20)
    assert "hashpartitioning(mesh_id" in plan and f", {n}), REPARTITION_BY_NUM" in plan


def zone(around, rings, r=5.0, most=60.0):
    """A globe's zone between two parallels, two triangles to a facet."""
    a, b = np.arange(around) * math.tau / around, np.radians(np.linspace(-most, most, rings))
    p = np.array([(r * math.cos(y) * math.cos(x), r * math.cos(y) * math.sin(x), r * math.sin(y)) for y in b for x in a])
    q = [(i * around + j, i * around + (j + 1) % around, (i + 1) * around + (j + 1) % around, (i + 1) * around + j) for i in range(rings - 1) for j in range(around)]
    return p, np.array([t for a, b, c, d in q for t in ((a, b, c), (a, c, d))])


def test_many_regions_are_merged_like_few():
    few, many = (segmentation.segment(*zone(around, rings), segmentation.SegmentOptions(max_dihedral=1.0)) for around, rings in ((16, 7), (48, 41)))
    assert len(few[0]) == len(many[0]) == 1 and few[1][0].kind == many[1][0].kind == "sphere"
    assert len(many[0][0]) == 2 * 48 * 40 and not many[3]


def test_fits_of_many_samples_are_those_of_each():
    p, t = zone(16, 7)
    p = p * [1, 1.3, 0.7] + 0.05 * np.sin(np.arange(3 * len(p))).reshape(-1, 3)
    n = segmentation.unit(segmentation.cross(p, t))
    rows = np.array([[(7 * k + 11 * i * (k + 1)) % len(t) for i in range(6)] for k in range(20)] + [[0, 1, 2, 3, 4, 5]])
    many = fitting.sampled_fits(p, t[rows], n[rows])
    for k, r in enumerate(rows):
        each = {f.kind: f.params for f in fitting.all_fits(p[np.unique(t[r])], n[r])}
        assert {kind for kind, ok, _ in many if ok[k]} == set(each)
        for kind, ok, q in many:
            if ok[k]:
                near = fitting.distance(kind, each[kind], p[t].mean(1)) <= 0.2
                near &= np.abs((fitting.normals_of(kind, each[kind], p[t].mean(1)) * n).sum(1)) >= 0.9
                assert q[k] == pytest.approx(each[kind], rel=1e-6, abs=1e-6) or kind == "plane" and q[k] == pytest.approx(-np.array(each[kind]), abs=1e-6)
                assert (fitting.holds(kind, q[k : k + 1], p[t].mean(1), n, 0.2, 0.9)[0] == near).all()


def test_auto_tries_the_second_way_only_where_it_can_win(monkeypatch):
    p, t = zone(16, 7)
    both = segmentation.ways(p[:, [0, 1, 2]] + 0.3 * np.sin(np.arange(3 * len(p))).reshape(-1, 3), t, segmentation.SegmentOptions(), True)
    assert [w[0] for w in both] == ["dihedral", "ransac"]
    monkeypatch.setattr(segmentation, "ransac", None)
    (only,) = segmentation.ways(p, t, segmentation.SegmentOptions(), True)
    assert only[0] == "dihedral" and len(only[1]) == 1 and only[2][0].kind == "sphere"


def test_links_that_branch_or_fall_apart_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(foundations, "LINKS", 2)
    monkeypatch.setattr(foundations, "label_components", None)
    fan = [(0, k, k + 1) for k in range(1, 40)] + [(0, 40, 1)]
    shells = [(0, a, b) for a, b in ((1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4))] + [(1, 3, 2), (4, 6, 5)]
    book, bow, one = [(0, 1, 2), (0, 1, 3), (0, 1, 4)], [(0, 1, 2), (2, 3, 4)], [(0, 1, 2)]
    m = mesh(spark, *(([(0, 0, 0)] * 41, t) for t in (fan, shells, book, bow, one, fan[:-1], [*fan[:10], *fan[15:20], *fan[25:]])))
    found = {tuple(r) for r in foundations.nonmanifold_vertices(m.triangles).collect()}
    assert found == {(1, 0), (2, 0), (2, 1), (3, 2), (6, 0)}
    assert foundations.pinched(*np.zeros((3, 0), int)).tolist() == []


def test_stored_steps_of_the_report_gather_no_table_on_the_driver(spark, monkeypatch):
    plans, keep = [], foundations.stored
    monkeypatch.setattr(foundations, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    (row,) = foundations.integrity_report(mesh(spark, (OCTA_P, OCTA_T))).collect()
    assert row["watertight"] and row["genus"] == 0
    assert plans and not any("Broadcast" in p for p in plans)
