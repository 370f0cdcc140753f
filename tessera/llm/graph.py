"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the least node reachable.

    Each round gives a node the least label among its own and its neighbours', then follows that label's own label twice,
    until nothing changes. Rounds are written to the shared folder. Counts are reduced before the shuffle, so a hub with a
    third of all links meets in partial minima; the join on it can be split by adaptive execution.
    """
    both = common.stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        met = labels.join(near, "a").select("a", "c", F.least("c", "m").alias("m"))
        for k in range(2):
            up = labels.select(F.col("a").alias(f"n{k}"), F.col("c").alias(f"u{k}"))
            met = met.join(up, F.col("m") == F.col(f"n{k}")).select("a", "c", F.least("m", f"u{k}").alias("m"))
        new = common.stored(met.select("a", F.col("m").alias("c"), (F.col("m") < F.col("c")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        common.discard(labels)
        labels = new
        if not moved:
            common.discard(both)
            out = labels.select(F.col("a").alias("node"), F.col("c").alias("component"))
            out._tessera_path = labels._tessera_path
            return out


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, component) of labels, if any, with further links (a, b), which may repeat.

    Links are first reduced to distinct ones between components, so only what changes is walked through.
    """
    if labels is None:
        return components(links)
    of = [labels.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"c{x}")) for x in "ab"]
    met = links.join(of[0], F.col("a") == F.col("na"), "left").join(of[1], F.col("b") == F.col("nb"), "left")
    met = met.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    met = common.stored(met, "merges")
    if met.isEmpty():
        common.discard(met)
        return labels
    up = components(met)
    # a component that moves takes its nodes with it; a node without a component so far was its own
    moved = labels.join(up.withColumnRenamed("node", "n").withColumnRenamed("component", "u"), F.col("component") == F.col("n"), "left")
    moved = moved.select("node", F.coalesce("u", "component").alias("component"))
    new = up.join(labels.select("node"), "node", "left_anti").select("node", "component")
    out = common.stored(moved.unionByName(new), "merged")
    common.discard(met, up)
    return out
