"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and connected components.

A document's set is its distinct ``k``-word shingles (A-Z lower-cased; fewer words: the whole sequence as one). Equal sets
are one class, named by the least doc_id. SuperMinHash gives each class ``HASHES`` values: every element draws a random
permutation of the slots step by step, with the step number in front of the draw, and a document stops once no slot
can improve. ``BANDS`` bands of ``ROWS`` values make the buckets.

Within a bucket not all pairs are emitted. Each bucket names one hub (the member that shares most buckets), and its members
are compared with the hub on full sets. Relative to a hub a member is linked, ambiguous (similarity of at least 0.7) or far.
Jaccard distance is a metric, so a linked and a far member can't be linked with each other, and two linked ones are connected
already. The others meet in buckets of single elements, which hold few members each:

- Ambiguous members, against each other and against linked ones: with r removed and a added elements against the hub and o
  elements in common among those, x and y are linked exactly when
  185 * o >= (100 * r + 85 * a of x) + (the same of y) - 15 * (size of the hub). So they share elements of their differences,
  and a prefix of the differences in a fixed order (added ones first) is enough: form 1 of an element holds ambiguous
  members, form 2 ambiguous with linked ones.
- Far members, against each other and against ambiguous ones: linked sets share one of their 15 % of elements that come first
  in any fixed order; the order is by how many sets of such buckets hold the element, the rarest first (form 3). Passages
  that thousands of documents share are thus left out, unless they are nearly all of a document.

Of such a bucket with at most ``SMALL`` members, of different components still, each pair that can be linked by size is verified,
so a member meets fewer than ``SMALL`` others in it. Larger ones get hubs again, four times as many in each round: those of rare
elements are split like a band's bucket, of the others members of one component leave, until every member was a hub. So every
pair of a band's bucket is verified, excluded by a proof, or connected already; with these numbers a pair at the threshold of
0.85 is in no common bucket with a probability of 1e-6, and pairs above it more rarely.

Links hold when 100 * intersection >= 85 * union. Null and empty texts have no set and are linked with nothing. Rows of one
id are one document; if their sets differ, it has the set with the least name. Rows without an id are linked with nothing,
have no component and stay. Very long texts are one set like others; the texts of a batch are bounded in bytes. Ties between
hubs fall to the lesser id. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, graph, shingles

K, THRESHOLD, NEAR = 5, 85, 70
BANDS, ROWS = 36, 7
HASHES = BANDS * ROWS
CHUNK = 128
#: Members of a bucket in which all that may be linked are verified at once.
SMALL = 64


def sets(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    with np.errstate(over="ignore"):
        h, _, _, first = shingles.words([t.lower() for t in texts])
        w = shingles.windows(h, k)
        out = []
        for i in range(len(texts)):
            a, b = first[i], first[i + 1]
            if a == b:
                out.append(np.zeros(0, np.uint64))
            elif b - a < k:
                out.append(shingles.mix(shingles.windows(h[a:b], int(b - a))[:1] + np.uint64(b - a)))
            else:
                out.append(np.unique(w[a : b - k + 1]))
        return out


def superminhash(elements: list[np.ndarray], m: int = HASHES) -> np.ndarray:
    """Signatures [sets, m] (uint64: step in the high half, draw in the low one); an empty set has all ones."""
    with np.errstate(over="ignore"):
        n = len(elements)
        sig = np.full((n, m), np.iinfo(np.uint64).max, np.uint64)
        flat = sig.reshape(-1)
        e = np.concatenate(elements) if n else np.zeros(0, np.uint64)
        d = np.repeat(np.arange(n), [len(x) for x in elements])
        perm = None
        for j in range(m):
            if not e.size:
                break
            r = shingles.mix(e + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1))
            k = j + (((r >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            if j == 0:
                slot = k
            else:
                rows = np.arange(e.size)
                slot = perm[rows, k]
                perm[rows, k] = perm[rows, j]
            np.minimum.at(flat, d * m + slot, (r & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32))
            open_ = sig.max(1) >= np.uint64((j + 1) << 32)
            live = open_[d]
            if j == 0:
                e, d, slot = e[live], d[live], slot[live]
                perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (e.size, m)).copy()
                rows = np.arange(e.size)
                perm[rows, slot] = 0
            elif not live.all():
                e, d, perm = e[live], d[live], perm[live]
        return sig


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """[sets, BANDS] int64; the band's number is part of the hash."""
    with np.errstate(over="ignore"):
        h = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            h = shingles.mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[:, r::ROWS])
        return h.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), set (16 bytes that name the set) and bands of every row of (doc_id, text)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                s = sets([x or b"" for x in part.column(1).to_pylist()])
                bands = band_hashes(superminhash(s))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in s], pa.int64()),
                        pa.array([digest(x) for x in s], pa.binary()),
                        pa.array([r if len(x) else r[:0] for r, x in zip(bands, s)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "set", "bands"],
                )

    rows = docs.select("doc_id", F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n long, set binary, bands array<long>")


LINKED, AMBIGUOUS, FAR = 0, 1, 2


def compared(x: np.ndarray, hub: np.ndarray, threshold: int = THRESHOLD) -> tuple[int, np.ndarray, int, int]:
    """How the set x stands to the hub, its difference (added elements, and the complements of removed ones), and of how many of
    them, in any fixed order, a partner must share one: between ambiguous members, and between an ambiguous and a linked one."""
    added, removed = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
    both, union = x.size - added.size, hub.size + added.size
    if 100 * both < NEAR * union:
        return FAR, added[:0], 0, 0
    cost, free = 100 * removed.size + threshold * added.size, (100 - threshold) * hub.size
    order = np.concatenate((added, ~removed))
    # The least number of shared elements. An ambiguous partner costs over ``free``; any partner costs ``threshold`` or more for each.
    strict = max(0, order.size - cost // (100 + threshold))
    if 100 * both >= threshold * union:
        return LINKED, order if strict else order[:0], 0, strict
    return AMBIGUOUS, order, strict, max(0, order.size - max(1, -(-(cost - free) // 100)) + 1)


def digest(x: np.ndarray) -> bytes:
    """The name of a set."""
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def verified(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b, main, kind, es, t1, t2 (see compared) of the pairs (a, hub b, main), from full sets; es of main pairs alone. texts: (rep, text)."""

    def run(batches):
        held: tuple = (None, None)
        for b in batches:
            out: list[tuple] = []
            ids = b.column(1).to_pylist()
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                for i, x in enumerate(sets([x or b"" for x in part.column(3).to_pylist()])):
                    if held[0] != ids[at + i]:
                        held = (ids[at + i], sets([part.column(4)[i].as_py() or b""])[0])
                    out.append(compared(x, held[1], threshold))
            lists = pa.array([o[1].view(np.int64) if m else o[1][:0].view(np.int64) for o, m in zip(out, b.column(2).to_pylist())], pa.list_(pa.int64()))
            numbers = [pa.array([o[k] for o in out], pa.int32()) for k in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), numbers[0], lists, *numbers[1:]], ["a", "b", "main", "kind", "es", "t1", "t2"])

    t = texts.select("rep", F.col("text").cast("binary").alias("t"))
    full = pairs.join(t.withColumnRenamed("rep", "a").withColumnRenamed("t", "ta"), "a").join(t.withColumnRenamed("rep", "b").withColumnRenamed("t", "tb"), "b")
    return full.select("a", "b", "main", "ta", "tb").mapInArrow(run, "a long, b long, main boolean, kind int, es array<long>, t1 int, t2 int")


def rarest(lists: DataFrame, takes: list[str]) -> DataFrame:
    """The columns of lists (with es array<long>, no further one named n, df or e) with one array for each of takes: of the
    elements of es, the first so many in the order by df (the rows that hold the element) and value, without those of one row
    alone. The latter are the front of the order and meet nobody, so they are counted, not listed. ``row`` names a row."""
    keys = [c for c in lists.columns if c != "es"]
    each = lists.select("row", F.explode("es").alias("e"))
    many = each.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = each.join(many, "e").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("met"))
    out = lists.select(*keys, F.size("es").alias("n")).join(met, "row")
    cut = [F.slice("met", 1, F.greatest(F.lit(0), F.col(t) - F.col("n") + F.size("met")))["e"].alias(f"first_{t}") for t in takes]
    return out.select(*keys, *cut)


def rare_prefixes(reps: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(rep, may, e): of the sets of reps (rep, may), the elements one of which any two linked sets share, the rarest first."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                s = sets([x or b"" for x in part.column(1).to_pylist()])
                lists = pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64()))
                takes = pa.array([len(x) - (threshold * len(x) + 99) // 100 + 1 for x in s], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), takes, lists], ["row", "may", "t", "es"])

    full = texts.join(reps, "rep").select("rep", F.col("text").cast("binary"), "may").mapInArrow(run, "row long, may boolean, t int, es array<long>")
    full = common.stored(full, "prefix-sets")
    out = common.stored(rarest(full, ["t"]).select(F.col("row").alias("rep"), "may", F.explode("first_t").alias("e")), "prefixes")
    common.discard(full)
    return out


BEST = "max(struct(fan, -rep AS neg, c, n)) AS h"


def hubs(left: DataFrame, lots: int) -> DataFrame:
    """(bucket, hub, hc, hn): of each large bucket, and each of ``lots`` parts of it, the member of most fan; of small ones every member that may be one."""
    lot = F.when(F.col("large"), F.pmod(F.xxhash64("rep"), F.lit(lots))).otherwise(F.col("rep"))
    best = left.where("may").withColumn("lot", lot).groupBy("bucket", "lot").agg(F.expr(BEST))
    return best.select("bucket", (-F.col("h.neg")).alias("hub"), F.col("h.c").alias("hc"), F.col("h.n").alias("hn"))


def leaders(left: DataFrame) -> DataFrame:
    """(bucket, hub, hc): one hub of each bucket, not always a member: of the buckets that its members are in, the member of most
    fan. So the buckets of a large group of copies have the same hub, mostly the text that the others were made from."""
    best = left.groupBy("bucket").agg(F.expr(BEST))
    mine = left.select("bucket", "rep").join(best, "bucket").groupBy("rep").agg(F.max("h").alias("h"))
    best = left.select("bucket", "rep").join(mine, "rep").groupBy("bucket").agg(F.max("h").alias("h"))
    return best.select("bucket", (-F.col("h.neg")).alias("hub"), F.col("h.c").alias("hc"), F.col("h.n").alias("hn"))


#: Columns of the members of buckets. form: 0 of a band, 1 of an element between ambiguous members, 2 of an element between ambiguous (may be hubs)
#: and linked ones, 3 of a rare element between far (may be hubs) and ambiguous ones; c: component; large: the bucket has more than SMALL members.
LEFT = ["bucket", "rep", "fan", "n", "c", "may", "form", "large"]


def alive(rest: DataFrame, fans: DataFrame) -> DataFrame:
    """The members (bucket, rep, c, may, form) of buckets with two components, a member that may be a hub, and of form 2 one that may not."""
    of = rest.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("may").alias("m"), F.min("may").alias("l"), F.max("form").alias("f"), F.count(F.lit(1)).alias("k"))
    of = of.where("c0 < c1 AND m AND (f <> 2 OR NOT l)").select("bucket", (F.col("k") > SMALL).alias("large"))
    return rest.join(of, "bucket").join(fans, "rep").select(LEFT)


def components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    common.byte_batches(spark)
    slim = common.pick(docs)
    rows = common.stored(signed(slim), "signatures")
    # rows of one id are one document: its set is the one with the least name
    twice = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("c"), F.min("set").alias("least")).where("c > 1").select("id", "least")
    named = rows.join(twice, F.col("doc_id") == F.col("id"), "left").withColumn("set", F.coalesce("least", "set")).drop("least")
    own = rows.join(twice, F.col("doc_id") == F.col("id"), "left").where("doc_id IS NOT NULL AND n > 0 AND (least IS NULL OR least = set)")
    classes = common.stored(own.groupBy("set", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = common.stored(members.join(shared, "bucket").select("bucket", "rep", "size"), "buckets")
    fans = common.stored(buckets.groupBy("rep").agg(F.sum("size").alias("fan")).join(classes.select("rep", "n"), "rep"), "fans")
    left = buckets.join(fans, "rep").select("bucket", "rep", "fan", "n", F.col("rep").alias("c"), F.lit(True).alias("may"), F.lit(0).alias("form"), F.lit(True).alias("large"))
    left = common.stored(left, "left")
    texts = common.stored(texts_of(slim, classes.join(fans.select("rep"), "rep").select("rep", "set")), "texts")
    kept = [rows, classes, fans, texts]
    common.discard(buckets)
    common.release(spark)
    labels, lots, start = None, 1, True
    # members whose relation to the hub splits the bucket; others are compared for links alone
    split = F.col("large") & F.col("form").isin(0, 3)
    while start or not left.isEmpty():
        hub = common.stored(leaders(left) if start else hubs(left, lots), "hubs")
        pairs = left.join(hub, "bucket").withColumn("main", split).where(
            f"rep <> hub AND (main OR c <> hc AND (large OR rep > hub OR NOT may) AND NOT (form = 2 AND may) AND 100 * least(n, hn) >= {threshold} * greatest(n, hn))"
        )
        pairs = common.stored(pairs.select("bucket", "rep", "hub", "form", "main"), "pairs")
        wanted = pairs.groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).agg(F.max("main").alias("main"))
        seen = common.stored(verified(wanted, texts, threshold), "seen")
        was, labels = labels, graph.merged(labels, seen.where(f"kind = {LINKED}").select("a", "b"))
        if was is not None and was is not labels:
            common.discard(was)
        kinds = pairs.where("main").join(seen.select(F.col("a").alias("rep"), F.col("b").alias("hub"), "kind"), ["rep", "hub"]).groupBy("bucket", "rep", "form")
        kinds = kinds.agg(F.min("kind").alias("k0"), F.max("kind").alias("k1")).where(f"k0 > {LINKED}")
        kinds = kinds.select("bucket", "rep", (F.col("k1") == FAR).alias("may"), "form")
        if not start:
            kinds = kinds.unionByName(left.where(~split & F.col("large")).select("bucket", "rep", "may", "form"))
        kinds = kinds.join(hub.select("bucket", F.col("hub").alias("rep")), ["bucket", "rep"], "left_anti")
        parts = seen.where("size(es) > 0").select(F.struct("a", "b").alias("row"), "kind", "t1", "t2", F.transform("es", lambda e: F.xxhash64("b", e)).alias("es"))
        parts = rarest(parts, ["t1", "t2"]).select(F.col("row.a").alias("rep"), (F.col("kind") == AMBIGUOUS).alias("may"), "first_t1", "first_t2")
        parts = [parts.select("rep", "may", F.lit(f).alias("form"), F.explode(f"first_t{f}").alias("e")) for f in (1, 2)]
        parts = parts[0].unionAll(parts[1]).select(F.xxhash64("e", "form").alias("bucket"), "rep", "may", "form")
        rest = common.stored(labelled(kinds.unionByName(parts), labels), "rest")
        old = [left, hub, pairs, seen, rest]
        left = common.stored(alive(rest, fans), "left")
        if start:
            prefixes = rare_prefixes(left.where("form = 0").groupBy("rep").agg(F.max("may").alias("may")), texts, threshold)
            rare = prefixes.select(F.xxhash64("e", F.lit(3)).alias("bucket"), "rep", "may", F.lit(3).alias("form"))
            old += [left, prefixes]
            left = common.stored(left.where("form <> 0").unionByName(alive(labelled(rare, labels), fans)), "left")
        common.discard(*old)
        lots, start = min(4 * lots, 256) if not start else 1, False
    common.discard(left)
    out = classes.select(F.col("set").alias("of"), "n", "rep")
    out = out.join(labels, F.col("rep") == F.col("node"), "left").select("of", F.col("n").alias("m"), F.coalesce("component", "rep").alias("c"))
    out = named.select("doc_id", "set").join(out, F.col("set") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id")
    out = common.stored(out.select("doc_id", F.coalesce("m", F.lit(0)).cast("long").alias("n_shingles"), component), "components")
    common.discard(*kept, *([labels] if labels is not None else []))
    return out


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with c, the component of rep."""
    return rows.join(labels, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the classes (rep, set): of rows with one id, the text whose set it is."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                names = [digest(x) for x in sets([x or b"" for x in part.column(1).to_pylist()])]
                mine = pa.array([x == y for x, y in zip(names, part.column(2).to_pylist())], pa.bool_())
                yield part.select([0, 1]).filter(mine)

    rows = docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), F.col("text").cast("binary"), "set")
    rows = rows.mapInArrow(run, "rep long, text binary")
    return rows.groupBy("rep").agg(F.min("text").alias("text"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component those of the least id, and rows without an id."""
    gone = components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(gone, "_id", "left_anti").select("row.*")


def op7_superminhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = components(common.table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
