"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A tree is a list of leaves (region, rack, weight); a leaf's place in the list is its shard number. A row descends level by
level. Among the children of a node it takes the one with the least draw -ln(u) / weight, where u comes from the md5 of
the row's key and the child's name and a node weighs what its leaves weigh. Draws do not depend on siblings: when a
weight changes, rows move only into or out of the subtrees that hold the changed leaf, and never between the others.
``grown`` opens further shards in regions of their own, so rows then move into the new shards only.

Everything is DataFrame expressions: no row moves for the placement, and one exchange of (key, shard) counts gives slots.

Null keys are placed by the key '' (a null id stays null); repeated rows go to the same shard and get a slot each; a null
text has size ``overhead`` and CRC-32 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.quality import CRC_TABLE, crc32_sql

OVERHEAD = 16
#: Parts of a shard in which slots are counted on their own; bounds the table of offsets at shards x parts.
PARTS = 64


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    weight: float = 1.0


def tree(shards: int, racks: int = 4, per_rack: int = 5) -> list[Leaf]:
    """A tree of equal shards, ``per_rack`` to a rack and ``racks`` to a region."""
    return [Leaf(f"g{s // (racks * per_rack)}", f"g{s // (racks * per_rack)}r{s // per_rack % racks}") for s in range(shards)]


def grown(leaves: list[Leaf], more: int = 1, weight: float = 1.0) -> list[Leaf]:
    """The tree with further shards, each in a region of its own."""
    return leaves + [Leaf(f"x{s}", f"x{s}r0", weight) for s in range(len(leaves), len(leaves) + more)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of md5(name:key)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}:"), key)), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 52)) / weight


def _child(key: Column, children: dict[str, float]) -> Column:
    """The name of the child with the least draw; the lesser name on ties."""
    names = sorted(n for n, w in children.items() if w > 0)
    if len(names) == 1:
        return F.lit(names[0])
    return F.array_min(F.array(*(F.struct(_draw(key, n, children[n]).alias("d"), F.lit(n).alias("n")) for n in names)))["n"]


def place(df: DataFrame, key: Column, leaves: list[Leaf], out: str) -> DataFrame:
    """Append ``out``, the shard (int) that the tree gives to the key (string)."""
    key = F.coalesce(key, F.lit(""))
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for s, leaf in enumerate(leaves):
        regions[leaf.region] = regions.get(leaf.region, 0) + leaf.weight
        racks.setdefault(leaf.region, {})
        racks[leaf.region][leaf.rack] = racks[leaf.region].get(leaf.rack, 0) + leaf.weight
        shards.setdefault(leaf.rack, {})[f"s{s:09d}"] = leaf.weight
    df = df.withColumn("_region", _child(key, regions))
    df = df.withColumn("_rack", _switch("_region", {r: _child(key, c) for r, c in racks.items() if regions[r] > 0}))
    weights = {k: sum(c.values()) for k, c in shards.items()}
    df = df.withColumn("_leaf", _switch("_rack", {r: _child(key, c) for r, c in shards.items() if weights[r] > 0}))
    return df.withColumn(out, F.substring("_leaf", 2, 9).cast("int")).drop("_region", "_rack", "_leaf")


def _switch(col: str, cases: dict[str, Column]) -> Column:
    out = None
    for name, then in cases.items():
        out = F.when(F.col(col) == name, then) if out is None else out.when(F.col(col) == name, then)
    return out


def slots(df: DataFrame, shard: str, order: list[str], parts: int = PARTS) -> DataFrame:
    """Append ``slot``: gapless from 0 in each shard. Each of ``parts`` hash parts of a shard is numbered by a task of its
    own after the sizes of the parts before it, so no task holds a whole shard."""
    df = df.withColumn("_part", (F.conv(F.substring(F.md5(F.concat_ws(":", *order)), 1, 8), 16, 10).cast("long") % parts).cast("int"))
    sizes = df.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.selectExpr(
        f"{shard} AS _shard", "_part AS _p", f"sum(_n) OVER (PARTITION BY {shard} ORDER BY _part ROWS UNBOUNDED PRECEDING) - _n AS _before"
    )
    ranked = df.selectExpr("*", f"row_number() OVER (PARTITION BY {shard}, _part ORDER BY {', '.join(order)}) - 1 AS _rank")
    joined = ranked.join(F.broadcast(before), (F.col(shard) == F.col("_shard")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long")).drop("_part", "_shard", "_p", "_before", "_rank")


def sharded(docs: DataFrame, leaves: list[Leaf], more: list[Leaf] | None = None, overhead: int = OVERHEAD, parts: int = PARTS) -> DataFrame:
    """Of every row: doc_id, size, text_crc32, shard, slot and, under the tree ``more``, grown_shard."""
    t = F.coalesce("text", F.lit(""))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32")
    )
    out = place(out, F.col("doc_id").cast("string"), leaves, "shard")
    out = place(out, F.col("doc_id").cast("string"), more, "grown_shard") if more else out.withColumn("grown_shard", F.lit(None).cast("int"))
    return slots(out, "shard", ["doc_id", "size", "text_crc32"], parts)


def op10_hash_tree_shards(spark, sf_dir: str) -> DataFrame:
    leaves = tree(40)
    out = sharded(common.table(spark, sf_dir, "documents"), leaves, grown(leaves))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draws_sql(children: dict[str, float]) -> str:
    """The least of the children's draws, in DuckDB."""
    one = lambda n, w: f"struct_pack(d := -ln((('0x' || substr(md5('{n}:' || k), 1, 13))::BIGINT + 0.5) / {1 << 52}::DOUBLE) / {w}, n := '{n}')"
    return f"list_min([{', '.join(one(n, w) for n, w in sorted(children.items()))}]).n"


def tree_sql(leaves: list[Leaf], rows: str) -> str:
    """DuckDB SQL for ``shard`` of the distinct keys k of ``rows``, level by level."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for s, x in enumerate(leaves):
        regions[x.region] = regions.get(x.region, 0) + x.weight
        of = racks.setdefault(x.region, {})
        of[x.rack] = of.get(x.rack, 0) + x.weight
        shards.setdefault(x.rack, {})[f"s{s:09d}"] = x.weight
    case = lambda col, cases: "CASE " + col + " " + " ".join(f"WHEN '{n}' THEN {_draws_sql(c)}" for n, c in cases.items()) + " END"
    level1 = f"SELECT k, {_draws_sql(regions)} AS region FROM {rows}"
    level2 = f"SELECT k, {case('region', racks)} AS rack FROM ({level1})"
    return f"SELECT k, substr({case('rack', shards)}, 2)::INT AS shard FROM ({level2})"


OP10_SQL = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (
  SELECT doc_id, doc_id::VARCHAR AS k, strlen(coalesce(text, '')) + {OVERHEAD} AS size,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {crc32_sql('text', 'tab')} END AS text_crc32
  FROM documents, crc),
keys AS MATERIALIZED (SELECT DISTINCT k FROM d),
a AS MATERIALIZED ({tree_sql(tree(40), 'keys')}),
b AS MATERIALIZED ({tree_sql(grown(tree(40)), 'keys')})
SELECT row_number() OVER (
         PARTITION BY a.shard
         ORDER BY ('0x' || substr(md5(doc_id::VARCHAR || ':' || size::VARCHAR || ':' || text_crc32::VARCHAR), 1, 8))::BIGINT % {PARTS}, doc_id, size, text_crc32) - 1 AS slot,
       doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, a.shard AS shard, b.shard AS grown_shard
FROM d JOIN a USING (k) JOIN b USING (k)
"""
