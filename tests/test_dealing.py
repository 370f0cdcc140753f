"""How mesh queries meet: meshes are dealt once, joins stay where they are, and shared steps are made once."""

import pytest

from tessera.model import TRIANGLES, VERTICES, Mesh
from tessera.operators import buffers, graph, segmentation


@pytest.mark.parametrize(
    "name, sorts",
    [
        ("mesh_crease_rings", 14), ("mesh_cross_sections", 9), ("mesh_shadow_indices", 8), ("mesh_tessellation_indices", 13),
        ("mesh_boundary_loops", 2), ("mesh_cluster_bounds", 8), ("mesh_aligned", 12), ("mesh_adjacency", 8),
    ],
)
def test_meshes_are_dealt_once_and_met_where_they_are(spark, name, sorts):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "BroadcastExchange" not in plan
    assert plan.count("Sort [") <= sorts


def test_corpus_queries_keep_the_session_as_it_was(spark):
    from tessera.model import joined_where_dealt

    name = "spark.sql.requireAllClusterKeysForCoPartition"
    joined_where_dealt(spark, False)
    own = spark.conf.get(name)
    joined_where_dealt(spark, True)
    assert spark.conf.get(name) == "false"
    joined_where_dealt(spark, False)
    assert spark.conf.get(name) == own


def test_links_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            made.add(len(pdf))
            yield pdf

    links = spark.range(4, numPartitions=2).selectExpr("id div 2 AS mesh_id", "2 * id AS a", "2 * id + 1 AS b").mapInPandas(counted, "mesh_id long, a long, b long")
    nodes = spark.range(8).selectExpr("id div 4 AS mesh_id", "id AS node")
    got = {(r.node, r.label) for r in graph.components(nodes, links).collect()}
    assert got == {(k, k - k % 2) for k in range(8)} and made.value == 4


def test_smooth_regions_over_edges_of_many_triangles(spark):
    # three triangles on one edge: two of them flat, one upright; a fourth by itself
    v = [(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 0.0, -1.0, 0.0), (0, 4, 0.0, 0.0, 1.0), (0, 5, 5.0, 5.0, 5.0)]
    t = [(0, 0, 0, 1, 2), (0, 1, 1, 0, 3), (0, 2, 0, 1, 4), (0, 3, 2, 3, 4)]
    mesh = Mesh(spark.createDataFrame(v, VERTICES), spark.createDataFrame(t, TRIANGLES))
    assert {(r.tid, r.label) for r in segmentation.smooth_regions(mesh, 20.0).collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)}


def test_places_that_are_no_number_are_equal_and_missing_ones_drop_out(spark):
    v = [(0, 0, float("nan"), 0.0, 0.0), (0, 1, float("nan"), -0.0, 0.0), (0, 2, None, 0.0, 0.0), (0, 3, 1.0, 0.0, 0.0)]
    mesh = Mesh(spark.createDataFrame(v, VERTICES), spark.createDataFrame([(0, 0, 0, 1, 3), (0, 1, 1, 2, 3), (0, 2, 0, 3, 9)], TRIANGLES))
    assert {(r.vid, r["first"]) for r in buffers.position_remap(mesh).collect()} == {(0, 0), (1, 0), (3, 3)}
    assert [tuple(r) for r in buffers.shadow_indices(mesh).collect()] == [(0, 0, 0, 0, 3)]


def test_tessellation_of_sides_without_length_and_of_many_triangles(spark):
    v = [(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 0.0, 0.0, 0.0), (0, 4, 1.0, 0.0, 0.0), (0, 5, 0.0, -1.0, 0.0)]
    t = [(0, 0, 0, 1, 2), (0, 1, 4, 3, 5), (0, 2, 1, 0, 5), (0, 3, 0, 3, 2)]
    mesh = Mesh(spark.createDataFrame(v, VERTICES), spark.createDataFrame(t, TRIANGLES))
    got = {r.tid: [(r[f"o{k}a"], r[f"o{k}b"]) for k in range(3)] for r in buffers.tessellation_indices(mesh).collect()}
    assert got == _opposite(v, t)


def _opposite(v, t):
    """Each side's opposite, by brute force: the first side that runs the other way between its places, turned."""
    at = {a[1]: min(b[1] for b in v if b[2:] == a[2:]) for a in v}
    sides = [(tid, k, x[k], x[(k + 1) % 3]) for _, tid, *x in t for k in range(3)]
    out = {}
    for tid, k, a, b in sides:
        o = min((s for s in sides if at[s[2]] == at[b] and at[s[3]] == at[a]), default=None)
        out.setdefault(tid, []).append((o[3], o[2]) if o else (a, b))
    return out
