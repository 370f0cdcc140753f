"""Mixing sources to target weights by Pareto order sampling.

``targets`` gives every source its share of a total by weight; a share stops at ``repeat`` times the source's size and the
excess goes to the others by weight until none is above (one level fills all sources: target = least(repeat * size,
level * weight)). Within a source, ``inclusions`` gives documents unequal expected copies: least(repeat, level * measure), where the measure
is the square root of the size's power of two, so a document of four times the length is expected twice as often, and the
level is such that the expected words are the target. The whole part of that is taken for
certain. For the rest, the inclusion probability p, documents are ranked by (u / (1 - u)) / (p / (1 - p)), with u from
the md5 of the id, and the sample has a fixed size in words: the shortest-ranked prefix whose words stay within what the target still lacks,
then the one further document of its source whose size is nearest to the gap, if it brings the total closer.

Ranks are cut into ``parts`` ordered parts; sizes are summed by source and part, and only the part in which a source's
prefix ends is ranked row by row, so a source that holds a third of all rows is never in one task. Sources meet their
targets by a join on (source, class of size, salt).

A null text has size 0 and is taken 0 times for the mix's words; a null source is a source of its own, the last by order;
ties in rank fall to the lesser id, then to the lesser CRC-32 of the text; rows that agree in all of these are
interchangeable. A very long text is a row like others. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
PARTS = 1024
SALTS = 32
#: The draws are odd multiples of half of 1 / UNIT.
UNIT = float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """skey, source_size, target of (skey, source, source_size), one row per source; sources are numbered by code point, null last."""
    w = f"array({', '.join(f'{float(x)!r}D' for x in weights)})"
    view = sizes.selectExpr("skey", "source_size", f"element_at({w}, cast((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} AS int) + 1) AS weight")
    view = view.selectExpr("*", f"cast({repeat} * source_size AS double) AS cap", f"{share!r}D * sum(source_size) OVER () AS total")
    order = "OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    view = view.selectExpr("*", f"(total - coalesce(sum(cap) {order}, 0)) / (sum(weight) OVER () - coalesce(sum(weight) {order}, 0)) AS level")
    # The first source that its level doesn't fill, by cap / weight, sets the level of all; if none, every source is full.
    view = view.selectExpr("*", "min_by(level, CASE WHEN level <= cap / weight THEN cap / weight END) OVER () AS water")
    return view.selectExpr("skey", "source_size", "CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target")


#: The class of a size, its binary digits less one, and the square root of its power of two.
CLASS = "length(bin(size)) - 1"
MEASURE = "power(2D, floor(k / 2)) * CASE WHEN k % 2 = 1 THEN 1.4142135623730951D ELSE 1D END"


def inclusions(words: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """skey, k, source_size, target, whole, p, rest of (skey, k, words, source_size, target), one row per source and class: the
    expected copies whole + p of the class, and the words that the source's target lacks after the whole ones."""
    view = words.selectExpr("*", f"{MEASURE} AS m").selectExpr("*", f"cast({repeat} * words AS double) AS cap", "words * m AS weight")
    order = "OVER (PARTITION BY skey ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    level = f"try_divide(target - coalesce(sum(cap) {order}, 0), sum(weight) OVER (PARTITION BY skey) - coalesce(sum(weight) {order}, 0))"
    # The longest class that its level doesn't fill sets the level of all; if none, every class is full.
    view = view.selectExpr("*", f"{level} AS level").selectExpr("*", f"max_by(level, CASE WHEN level * m <= {repeat} THEN k END) OVER (PARTITION BY skey) AS water")
    view = view.selectExpr("*", f"CASE WHEN source_size = 0 THEN 0D WHEN water IS NULL THEN {float(repeat)!r}D ELSE least({float(repeat)!r}D, water * m) END AS copies")
    view = view.selectExpr("*", "floor(copies) AS whole")
    return view.selectExpr("skey", "k", "source_size", "target", "whole", "copies - whole AS p", "target - sum(whole * words) OVER (PARTITION BY skey) AS rest")


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeat: int = REPEAT,
    parts: int = PARTS,
    salts: int = SALTS,
) -> DataFrame:
    """Of every row: doc_id, crc (of the text), size, source_size, target, copies and taken."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        common.word_count(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"),
    )
    slim = slim.withColumn("skey", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source")))
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    base = common.stored(slim.withColumn("u", (bits + 0.5) / UNIT), "mix")
    slim = base.withColumn("k", F.expr(CLASS))
    words = slim.groupBy("skey", "k").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    sizes = words.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    aims = common.stored(inclusions(words.drop("source").join(targets(sizes, weights, share, repeat), "skey"), repeat), "mix-targets")

    salted = aims.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = slim.withColumn("salt", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(salts)).cast("int")).join(salted, ["skey", "k", "salt"]).drop("salt")
    # q / (1 + q) for the rank q = odds(u) / odds(p): in (0, 1), in the order of q, and not dense where the prefix ends (q near 1)
    rank = F.when(F.col("p") <= 0, 1.0).otherwise(F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + F.col("p") * (1 - F.col("u"))))
    rows = rows.withColumn("rank", rank).withColumn("part", F.least(F.floor(F.col("rank") * parts), F.lit(parts - 1)).cast("int"))

    summed = rows.groupBy("skey", "part").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    summed = summed.selectExpr("skey", "part", "n", "rest", "sum(n) OVER (PARTITION BY skey ORDER BY part ROWS UNBOUNDED PRECEDING) - n AS before")
    ends = summed.where("before <= rest").groupBy("skey").agg(F.max("part").alias("end"), F.max_by("before", "part").alias("before"))
    ends = common.stored(ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "mix-ends")
    salt = F.pmod(F.xxhash64("doc_id", "crc"), F.lit(salts)).cast("int")
    rows = rows.withColumn("salt", salt).join(ends, ["skey", "salt"], "left").drop("salt")
    inside = rows.where("part = end")
    inside = inside.selectExpr("*", "before + sum(size) OVER (PARTITION BY skey ORDER BY rank, doc_id, crc ROWS UNBOUNDED PRECEDING) AS upto")
    inside = inside.withColumn("chosen", (F.col("p") > 0) & (F.col("upto") <= F.col("rest")))
    outside = rows.where("end IS NULL OR part <> end").withColumn("upto", F.lit(None).cast("long")).withColumn("chosen", (F.col("p") > 0) & F.coalesce(F.col("part") < F.col("end"), F.lit(False)))
    picked = common.stored(inside.unionByName(outside).drop("before", "end", "part", "upto", "u", "k"), "mix-picked")

    held = picked.groupBy("skey").agg(F.first("rest").alias("rest"), F.coalesce(F.sum(F.when(F.col("chosen"), F.col("size"))), F.lit(0)).alias("got"))
    gaps = held.selectExpr("skey", "rest - got AS gap").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spare = picked.where("NOT chosen AND p > 0 AND size > 0").withColumn("salt", salt).join(gaps, ["skey", "salt"])
    extra = spare.groupBy("skey").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "doc_id", "crc", "gap")).alias("x"))
    extra = extra.where("x.off < x.gap").selectExpr("skey", "x.rank AS xrank", "x.doc_id AS xid", "x.crc AS xcrc")
    extra = extra.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    done = picked.withColumn("salt", salt).join(extra, ["skey", "salt"], "left")
    also = F.coalesce((F.col("rank") == F.col("xrank")) & F.col("doc_id").eqNullSafe(F.col("xid")) & (F.col("crc") == F.col("xcrc")), F.lit(False))
    copies = (F.col("whole") + (F.col("chosen") | also).cast("long")).cast("long")
    out = done.select("doc_id", "crc", "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    out = common.stored(out, "mixed")
    common.discard(base, aims, ends, picked)
    return out


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their own columns."""
    got = mixed(docs, **options).select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), "copies").groupBy("_id", "_crc").agg(F.max("copies").alias("_copies"))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc")
    )
    out = rows.join(got.where("_copies > 0"), rows["_id"].eqNullSafe(got["_id"]) & (rows["_crc"] == got["_crc"]))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")


def op5_pareto_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS skey,
         len(list_filter(str_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / {UNIT!r} AS u
  FROM documents),
s AS (SELECT skey, any_value(source) AS source, sum(size) AS source_size FROM d GROUP BY skey),
w AS (
  SELECT skey, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         ({REPEAT} * source_size)::DOUBLE AS cap, ({SHARE} * sum(source_size) OVER ())::DOUBLE AS total
  FROM s),
filled AS (SELECT w.skey, w.cap, w.weight, (w.total - coalesce(sum(o.cap), 0)) / (any_value(a.all_w) - coalesce(sum(o.weight), 0)) AS level
  FROM w CROSS JOIN (SELECT sum(weight) AS all_w FROM w) a
  LEFT JOIN w o ON o.cap / o.weight < w.cap / w.weight OR (o.cap / o.weight = w.cap / w.weight AND o.skey < w.skey)
  GROUP BY w.skey, w.cap, w.weight, w.total),
water AS (SELECT min_by(level, cap / weight) AS water FROM filled WHERE level <= cap / weight),
aim AS (SELECT w.skey, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM w, water),
cls AS (
  SELECT skey, k, words, source_size, target, power(2, k // 2) * CASE WHEN k % 2 = 1 THEN 1.4142135623730951::DOUBLE ELSE 1 END AS m
  FROM (SELECT skey, length(bin(size)) - 1 AS k, sum(size)::BIGINT AS words FROM d GROUP BY ALL) JOIN aim USING (skey)),
lev AS (
  SELECT *, (target - coalesce(sum({REPEAT} * words) OVER w, 0)) / nullif(sum(words * m) OVER (PARTITION BY skey) - coalesce(sum(words * m) OVER w, 0), 0) AS level
  FROM cls WINDOW w AS (PARTITION BY skey ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (
  SELECT l.*, CASE WHEN source_size = 0 THEN 0 WHEN x.water IS NULL THEN {REPEAT}::DOUBLE ELSE least({REPEAT}::DOUBLE, x.water * m) END AS copies
  FROM lev l LEFT JOIN (SELECT skey, max_by(level, k) AS water FROM lev WHERE level * m <= {REPEAT} GROUP BY skey) x USING (skey)),
m AS (
  SELECT skey, k, source_size, target, floor(copies) AS whole, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY skey) AS rest FROM e),
r AS MATERIALIZED (
  SELECT doc_id, d.skey, size, source_size, target, whole, p, rest, CASE WHEN p <= 0 THEN 1.0 ELSE u * (1 - p) / (u * (1 - p) + p * (1 - u)) END AS rank
  FROM d JOIN m ON d.skey = m.skey AND length(bin(d.size)) - 1 = m.k),
c AS MATERIALIZED (SELECT *, p > 0 AND sum(size) OVER (PARTITION BY skey ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS chosen FROM r),
g AS (SELECT skey, any_value(rest) - coalesce(sum(size) FILTER (WHERE chosen), 0) AS gap FROM c GROUP BY skey),
x AS (
  SELECT skey, min(struct_pack(off := abs(size - gap), rank := rank, doc_id := doc_id)) AS x, any_value(gap) AS gap
  FROM c JOIN g USING (skey) WHERE NOT chosen AND p > 0 AND size > 0 GROUP BY skey)
SELECT c.doc_id, c.size, c.source_size::BIGINT AS source_size, c.target,
       ((whole + (chosen OR coalesce(x.x.doc_id = c.doc_id AND x.x.off < x.gap, false))::INT) * c.size)::BIGINT AS taken
FROM c LEFT JOIN x USING (skey)
"""
