"""Repeated passages by compaction of a de Bruijn graph of word windows.

The edges of the graph are the ``SPAN``-word windows of all documents, its nodes the windows one word shorter: an edge leads
from its first words to its last ones, and the next window of a text leaves the node that the one before enters.

1. Consecutive edges of a text that share a minimiser (the least hash of their ``MINI``-word windows) are one path at once:
   equal windows have equal minimisers, so paths with different minimisers never share an edge. Minimisers are counted; those
   of one path alone, without a window twice, can't hold a repeated edge.
2. Paths of the others are joined to them, and equal paths become one, with its first place and the degrees of its end
   nodes: the least and greatest path that follows it, and that it follows, with none as a value of its own.
3. A path is branching if its minimiser has paths of different content, or a window twice. Where a path that doesn't branch has one
   follower only, that has no other predecessor, the two are linked; chains of links are compacted by pointer doubling, a join a round.
   Every place of a chain's head is a place of the whole chain, so all but the first are repeated spans of it.
4. The edges of branching paths are expanded from their first places, and each edge gets the place where it starts first.
5. Spans of a document that continue each other here and at the source are joined, and verified at the coordinates: the
   BLAKE2b digest of the words of the span must be that of the words at the source. The windows of spans that fail (hashes that agree for different
   words) are decided by their words themselves.
6. The words of verified spans are removed.

Windows are thus judged by words, not by hashes. Counts and minima are reduced before each shuffle; joins on minimisers have one
row per minimiser on one side, so adaptive execution can split a hot one. Bitmaps of a fixed size (``BITS`` bits) hold back rows and texts that no join can use; when
they fill up, more rows are shuffled, and the result stays.

Null and empty texts have no words. Texts shorter than a window are kept whole. Very long texts are one row with one list of spans. Rows of one id are taken for one
document: repeated rows are treated alike, and of rows that differ a word leaves where the window at its place also starts earlier in any
of them. Rows without an id take no part and are kept whole. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, shingles

SPAN, MINI = 20, 8
#: Longest path, in windows; a longer one is cut into several.
PATH = 32
CHUNK = 128
#: Log2 of the bits of a bitmap.
BITS = 26


def _least(a: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours, from each place on; the last k - 1 are void."""
    have, out = 1, a
    while have * 2 <= k:
        out = np.concatenate((np.minimum(out[:-have], out[have:]), out[-have:])) if out.size > have else out
        have *= 2
    rest = k - have
    return np.concatenate((np.minimum(out[:-rest], out[rest:]), out[-rest:])) if rest and out.size > rest else out


def edges(texts: list[bytes], bits: int = 64, span: int = SPAN):
    """Words' hashes (of fewer bits in tests, so that different words agree), first word of each text, and the text, place and hash of every window."""
    h, _, _, first = shingles.words(texts)
    h = h >> np.uint64(64 - bits)
    whose = np.repeat(np.arange(len(texts)), np.diff(first))
    at = np.nonzero(whose[: max(0, h.size - span + 1)] == whose[span - 1 :])[0] if h.size >= span else np.zeros(0, np.int64)
    return h, first, whose, at, shingles.windows(h, span)[at] if at.size else np.zeros(0, np.uint64)


def paths(texts: list[bytes], bits: int = 64, span: int = SPAN, mini: int = MINI) -> list[np.ndarray]:
    """Of all paths: text number, first window's start, windows, minimiser, id, the ids of the paths before and after it in its text (0: none), and
    whether a window may come twice."""
    with np.errstate(over="ignore"):
        h, first, whose, at, edge = edges(texts, bits, span)
        if not at.size:
            z = np.zeros(0, np.int64)
            return [z, z, z, z, z, z, z, z.astype(bool)]
        least = _least(shingles.windows(h, mini), span - mini + 1)[at]
        new = np.ones(at.size, bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.maximum.accumulate(np.where(new, np.arange(at.size), 0))
        new |= (np.arange(at.size) - begin) % PATH == 0
        starts = np.nonzero(new)[0]
        n = np.diff(np.append(starts, at.size))
        place = (np.arange(at.size) - np.repeat(starts, n)).astype(np.uint64)
        content = np.add.reduceat(shingles.mix(edge + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), starts)
        ids = shingles.mix(content + shingles.mix(least[starts] + n.astype(np.uint64)))
        ids = np.where(ids == 0, np.uint64(1), ids).view(np.int64)
    run = np.repeat(np.arange(starts.size, dtype=np.uint64), n)
    key = np.sort((run << np.uint64(32)) | (edge >> np.uint64(32)))
    twice = np.zeros(starts.size, bool)
    twice[(key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64)] = True
    doc = whose[at[starts]]
    prev, succ = np.zeros(starts.size, np.int64), np.zeros(starts.size, np.int64)
    same = np.nonzero(doc[1:] == doc[:-1])[0]
    prev[same + 1], succ[same] = ids[same], ids[same + 1]
    return [doc, at[starts] - first[doc], n, least[starts].view(np.int64), ids, prev, succ, twice]


def _bit(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (shingles.mix(x.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def bitmap(values: DataFrame) -> np.ndarray:
    """2^BITS flags, of which those of the values (one column of long) are set."""

    def run(batches):
        have = np.zeros(1 << BITS, bool)
        for b in batches:
            have[_bit(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = True
        packed = np.packbits(have).view(np.int64)
        at = np.nonzero(packed)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["cell", "bits"])

    rows = values.mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(1 << (BITS - 6), np.int64)
    packed[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return packed


def _marked(flags: np.ndarray, x: np.ndarray) -> np.ndarray:
    bit = _bit(np.ascontiguousarray(x, np.int64))
    return (flags.view(np.uint8)[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def _texts(b: pa.RecordBatch, column: int = 1):
    """Slices of a batch with their texts."""
    for at in range(0, b.num_rows, CHUNK):
        part = b.slice(at, CHUNK)
        yield part, [x or b"" for x in part.column(column).to_pylist()]


def counted(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Minimisers of paths that may hold a repeated edge: (m)."""

    def run(batches):
        for b in batches:
            for _, texts in _texts(b):
                _, _, _, m, _, _, _, twice = paths(texts, bits)
                m, where = np.unique(m, return_inverse=True)
                c = np.bincount(where, 1 + twice, m.size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(c)], ["m", "c"])

    return docs.mapInArrow(run, "m long, c long").groupBy("m").agg(F.sum("c").alias("c")).where("c > 1").select("m")


PLACED = "m long, id long, doc_id long, start int, n int, prev long, succ long, twice boolean"


def placed(docs: DataFrame, flags, bits: int = 64) -> DataFrame:
    """The paths whose minimiser's flag is set."""

    def run(batches):
        for b in batches:
            for part, texts in _texts(b):
                doc, start, n, m, ids, prev, succ, twice = paths(texts, bits)
                hit = _marked(flags.value, m)
                key = part.column(0).to_numpy(zero_copy_only=False)[doc[hit]]
                columns = [m[hit], ids[hit], key.astype(np.int64), start[hit].astype(np.int32), n[hit].astype(np.int32), prev[hit], succ[hit], twice[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "id", "doc_id", "start", "n", "prev", "succ", "twice"])

    return docs.mapInArrow(run, PLACED)


def holding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) whose id's flag is set by ids (one column): all that are among ids, and few others."""
    flags = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_marked(flags.value, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))

    return docs.mapInArrow(run, "doc_id long, text binary")


def fetched(docs: DataFrame, wanted: DataFrame, of, kind: str) -> DataFrame:
    """(doc_id, start, n, value) of the spans wanted (doc_id, start, n: windows): ``of(words' text, start, n)`` per document gives the values."""
    wanted = common.stored(wanted.select("doc_id", "start", "n").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("at")), "wanted")

    def run(batches):
        for b in batches:
            ids, starts, ns, values = [], [], [], []
            for d, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                a, n = (at.values.field(k).to_numpy() for k in ("start", "n"))
                ids += [d] * len(a)
                starts.append(a)
                ns.append(n)
                values += of(text.as_py() or b"", a.tolist(), n.tolist())
            columns = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x) if x else [], pa.int32()) for x in (starts, ns)), pa.array(values, pa.binary() if kind == "binary" else pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n", "value"])

    rows = holding(docs, wanted.select("doc_id")).join(wanted, "doc_id").select("doc_id", "text", "at")
    out = common.stored(rows.mapInArrow(run, f"doc_id long, start int, n int, value {kind}"), "fetched")
    common.discard(wanted)
    return out


def _digests(text: bytes, starts: list[int], ns: list[int]) -> list[bytes]:
    words = text.split()
    return [hashlib.blake2b(b" ".join(words[a : a + n + SPAN - 1]), digest_size=16).digest() for a, n in zip(starts, ns)]


def _hashes(bits: int):
    def of(text: bytes, starts: list[int], ns: list[int]) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            e = edges([text], bits)[4].view(np.int64)
        return [e[a : a + n] for a, n in zip(starts, ns)]

    return of


def chains(unique: DataFrame) -> DataFrame:
    """(head, windows): the chains of linked paths among those of unique that repeat and don't branch, by pointer doubling."""
    able = unique.where("c > 1 AND NOT branch AND alone").select("id", "n", "p0", "p1", "s0", "s1")
    follows = able.where("p0 = p1 AND p0 <> 0 AND p0 <> id").select("id", "n", F.col("p0").alias("up"))
    before = able.where("s0 = s1").select(F.col("id").alias("up"), F.col("s0").alias("next"), F.col("n").alias("d"))
    # d: windows from the start of the path that up names to that of this one
    links = follows.join(before, "up").where("next = id").select("id", "up", F.col("d").cast("long").alias("d"))
    links = common.stored(links, "links")
    while True:
        further = links.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        new = links.join(further, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.col("up2").isNotNull().alias("moved"))
        new = common.stored(new, "links")
        moved = not new.where("moved").isEmpty()
        common.discard(links)
        links = new
        if not moved:
            break
    ends = able.select("id", "n").join(links.select("id", "up", "d"), "id", "left").groupBy(F.coalesce("up", "id").alias("id"))
    out = common.stored(ends.agg(F.max(F.coalesce("d", F.lit(0)) + F.col("n")).cast("int").alias("windows")), "chains")
    common.discard(links)
    return out


def spans(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, start, n, sdoc, sstart): the spans of n windows whose hashes say that they start first at (sdoc, sstart), which is an earlier place."""
    spark = docs.sparkSession
    again = common.stored(counted(docs, bits), "minimisers")
    common.release(spark)
    flags = spark.sparkContext.broadcast(bitmap(again))
    found = common.stored(placed(docs, flags, bits).join(again, "m"), "paths")
    common.release(spark)
    here = F.struct("doc_id", "start")
    ends = [F.min("prev").alias("p0"), F.max("prev").alias("p1"), F.min("succ").alias("s0"), F.max("succ").alias("s1")]
    unique = common.stored(found.groupBy("m", "id").agg(F.min(here).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("c"), F.max("twice").alias("twice"), *ends), "compact")
    of_m = unique.groupBy("m").agg(((F.count(F.lit(1)) > 1) | F.max("twice")).alias("branch"))
    twins = unique.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id", F.lit(False).alias("alone"))
    flagged = unique.join(of_m, "m").join(twins, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(True)))
    flagged = common.stored(flagged.where("branch OR c > 1"), "flagged")
    common.discard(again, unique)

    heads = chains(flagged)
    whole = flagged.where("c > 1 AND NOT branch AND alone").join(heads, "id").select("m", "id", "first", "windows")
    lone = flagged.where("c > 1 AND NOT branch AND NOT alone").select("m", "id", "first", F.col("n").alias("windows"))
    chained = found.select("m", "id", "doc_id", "start").join(whole.unionByName(lone), ["m", "id"]).where(F.col("first") < here)
    chained = chained.select("doc_id", "start", F.col("windows").alias("n"), F.col("first.doc_id").alias("sdoc"), F.col("first.start").alias("sstart"))

    branch = common.stored(flagged.where("branch").select("m", "id", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "n"), "branching")
    hashes = fetched(docs, branch, _hashes(bits), "array<long>")
    # rows of one id may differ in text: then a place has several windows, and all of them count
    each = branch.join(hashes, ["doc_id", "start", "n"]).select("m", "id", "doc_id", "start", F.posexplode("value").alias("i", "e"))
    each = common.stored(each.select("m", "id", "i", "e", "doc_id", (F.col("start") + F.col("i")).alias("start")), "edges")
    least = each.groupBy("m", "e").agg(F.min(here).alias("f"))
    firsts = each.join(least, ["m", "e"]).groupBy("m", "id", "i").agg(F.min("f").alias("f")).groupBy("m", "id").agg(F.collect_list(F.struct("i", "f")).alias("firsts"))
    single = found.select("m", "id", "doc_id", "start").join(firsts, ["m", "id"])
    earlier = F.filter(F.transform("firsts", lambda x: F.struct((F.col("start") + x["i"]).alias("start"), x["f"].alias("f"))), lambda x: x["f"] < F.struct(F.col("doc_id"), x["start"].alias("start")))
    single = single.select("doc_id", F.explode(earlier).alias("x")).select("doc_id", "x.start", F.lit(1).alias("n"), F.col("x.f.doc_id").alias("sdoc"), F.col("x.f.start").alias("sstart"))
    out = common.stored(joined(chained.unionByName(single)), "spans")
    common.discard(found, flagged, heads, branch, hashes, each)
    common.release(spark)
    return out


def joined(rows: DataFrame) -> DataFrame:
    """Spans that continue each other, here and at the source, as one. A document's spans are as many as its windows at most."""
    rows = rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "sdoc", "sstart")).alias("s"))

    def run(batches):
        for b in batches:
            for d, s in zip(b.column(0).to_pylist(), b.column(1)):
                start, n, sdoc, sstart = (s.values.field(k).to_numpy().astype(np.int64) for k in ("start", "n", "sdoc", "sstart"))
                order = np.lexsort((start, sstart - start, sdoc))
                start, n, sdoc, sstart = start[order], n[order], sdoc[order], sstart[order]
                new = np.ones(start.size, bool)
                end = np.maximum.accumulate(start + n)
                new[1:] = (sdoc[1:] != sdoc[:-1]) | ((sstart - start)[1:] != (sstart - start)[:-1]) | (start[1:] > (start + n)[:-1])
                at = np.nonzero(new)[0]
                last = np.maximum.reduceat(start + n, at) if at.size else end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * at.size, pa.int64()), *(pa.array(x, pa.int32()) for x in (start[at], last - start[at])), pa.array(sdoc[at], pa.int64()), pa.array(sstart[at], pa.int32())],
                    ["doc_id", "start", "n", "sdoc", "sstart"],
                )

    return rows.mapInArrow(run, "doc_id long, start int, n int, sdoc long, sstart int")


def resolved(docs: DataFrame, doubtful: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, start, n = 1): the windows that also start earlier, among all with the hash of a window of doubtful (doc_id, start, n), by their words."""
    hashes = fetched(docs, doubtful, _hashes(bits), "array<long>")
    keys = common.stored(hashes.select(F.explode("value").alias("e")).distinct(), "doubtful")
    flags = docs.sparkSession.sparkContext.broadcast(bitmap(keys))

    def run(batches):
        for b in batches:
            for part, texts in _texts(b):
                with np.errstate(over="ignore"):
                    _, first, whose, at, edge = edges(texts, bits)
                hit = np.nonzero(_marked(flags.value, edge.view(np.int64)))[0]
                words, ids = [t.split() for t in texts], part.column(0).to_pylist()
                doc = whose[at[hit]]
                start = at[hit] - first[doc]
                held = [b" ".join(words[d][s : s + SPAN]) for d, s in zip(doc.tolist(), start.tolist())]
                columns = [pa.array(edge[hit].view(np.int64)), pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array(start, pa.int32()), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["e", "doc_id", "start", "words"])

    places = common.stored(docs.mapInArrow(run, "e long, doc_id long, start int, words binary").join(keys, "e"), "doubtful-windows")
    firsts = places.groupBy("words").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    out = places.join(firsts, "words").where(F.col("first") < F.struct("doc_id", "start")).select("doc_id", "start", F.lit(1).alias("n")).distinct()
    out = common.stored(out, "resolved")
    common.discard(hashes, keys, places)
    return out


def repeats(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, spans): of every document with a window that also starts earlier, (first window, windows) of those."""
    spark = docs.sparkSession
    common.byte_batches(spark)
    slim = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary"))
    found = spans(slim, bits)
    sides = found.select("doc_id", "start", "n").unionAll(found.select("sdoc", "sstart", "n"))
    values = fetched(slim, sides, _digests, "binary")
    one = values.groupBy("doc_id", "start", "n").agg(F.min("value").alias("v0"), F.max("value").alias("v1"))
    one = common.stored(one.select("doc_id", "start", "n", F.when(F.col("v0") == F.col("v1"), F.col("v0")).alias("here")), "digests")
    source = one.select(F.col("doc_id").alias("sdoc"), F.col("start").alias("sstart"), "n", F.col("here").alias("there"))
    checked = found.join(one, ["doc_id", "start", "n"]).join(source, ["sdoc", "sstart", "n"])
    checked = common.stored(checked.select("doc_id", "start", "n", F.coalesce(F.col("here") == F.col("there"), F.lit(False)).alias("same")), "checked")
    good, done = checked.where("same").select("doc_id", "start", "n"), [found, values, one, checked]
    if not checked.where("NOT same").isEmpty():
        exact = resolved(slim, checked.where("NOT same"), bits)
        good = good.unionByName(exact)
        done.append(exact)
    out = common.stored(good.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "repeats")
    common.discard(*done)
    common.release(spark)
    return out


def deduplicated(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    slim = common.pick(docs)

    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for x, s in zip(b.column(1), b.column(2)):
                w = (x.as_py() or b"").split()
                gone = 0
                if s.is_valid:
                    mark = np.zeros(len(w) + 1, np.int64)
                    v = s.values
                    a, n = v.field("start").to_numpy(), v.field("n").to_numpy()
                    np.add.at(mark, np.minimum(a, len(w)), 1)
                    np.add.at(mark, np.minimum(a + n + SPAN - 1, len(w)), -1)
                    stay = np.cumsum(mark[:-1]) == 0
                    gone = len(w) - int(stay.sum())
                    w = [y for y, k in zip(w, stay.tolist()) if k]
                n_words.append(len(w) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    rows = slim.join(repeats(slim, bits), "doc_id", "left").select("doc_id", F.col("text").cast("binary"), "spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op3_debruijn_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
