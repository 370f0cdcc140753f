"""Quality rules, mixing, sharding and the pipeline's stages on nulls, repeats, ties, long texts, empty tables and clashing names."""

import random
import zlib

import pytest

import corpus_pipeline
from tessera.llm import common, mixing, neardup, packing, quality, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, _w string, row string, shard int, _id string, n long, rank string, taken long"


def table(spark, more=()):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 200))), "en", ("a", "b", None, "a")[i % 4]) for i in range(80)]
    rows += [(200, None, None, None), (201, "", "en", "b"), (202, " \n", "en", "a"), (None, "no id " * 30, "en", "a"), (3, rows[3][1], "en", "a"), (3, rows[3][1], "en", "a"), (204, "long word " * 60_000, "en", "z")]
    rows += [*more]
    return spark.createDataFrame([(*x, len(x[1] or ""), 1, True, "w", "r", 2, "i", 3, "k", 4) for x in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, int(d % 2), 0, "x") for d in range(40)] + [(None, 1, 0, "x"), (3, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")


def test_quality_counts_and_verdicts(docs, labels):
    got = quality.judged(docs, labels).collect()
    assert len(got) == docs.count()
    for x in got:
        w = (x.row.text or "").split()
        if len(w) < 5000:
            win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            again = {j for i, k in enumerate(win) if win.count(k) > 1 for j in (i, i + 1, i + 2)}
            assert (x.n_words, x.word_chars, x.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert x.base_failed == (len(w) < 50 or 100 * x.n_repeat_words > 50 * len(w)) and (not x.base_failed or not x.kept)
    assert len({(x.kept, x.llr_sum) for x in got if x.doc_id == 3}) == 1 and next(x for x in got if x.doc_id == 204).n_repeat_words == 120_000
    assert quality.kept_rows(docs, labels).columns == docs.columns and quality.judged(docs.limit(0), labels).count() == 0
    assert quality.judged(docs, labels.limit(0)).where("llr_sum <> 0").count() == 0


def test_mix_meets_its_targets(docs):
    got = mixing.mixed(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    sources = docs.selectExpr("doc_id", "coalesce(source, '-') AS source").distinct().toPandas()
    by = got.merge(sources, on="doc_id", how="left").groupby("source")
    for _, g in by:
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1e-6 and g.target.iloc[0] <= 2 * g.source_size.iloc[0] + 1e-6
    assert abs(by.target.first().sum() - 1.5 * got["size"].sum()) < 1e-6 * got["size"].sum()
    again = mixing.mixed(docs.repartition(3)).toPandas()
    key = ["doc_id", "crc", "taken"]
    assert got.sort_values(key).taken.tolist() == again.sort_values(key).taken.tolist()
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.repeated(docs.limit(0)).count() == 0
    out = mixing.repeated(docs)
    assert out.columns == docs.columns


def test_inclusion_frequencies(spark):
    """Documents of four times the length are expected twice as often, and come so."""
    ids = spark.range(24_000).selectExpr("id AS doc_id", "repeat('w ', CASE WHEN id % 3 = 0 THEN 4 WHEN id % 3 = 1 THEN 16 ELSE 64 END) AS text", "CASE WHEN id % 10 < 8 THEN 'big' ELSE 'a' END AS source")
    got = mixing.mixed(ids, weights=(5, 1)).toPandas().merge(ids.select("doc_id", "source").toPandas(), on="doc_id")
    big = got[got.source == "big"]
    sums = big.groupby("size")["size"].sum()
    level = big.target.iloc[0] / sum(n * m for n, m in zip(sums[[4, 16, 64]], (2, 4, 8)))
    assert level * 8 < 2
    for size, m in ((4, 2), (16, 4), (64, 8)):
        share = big[big["size"] == size].copies
        assert abs(share.mean() - level * m) < 4 * (share.std() / len(share) ** 0.5) + 0.01
    # ranks by hand: within a class without whole copies the least draws are taken
    few = big[(big["size"] == 4)].sort_values("doc_id")
    import hashlib

    u = [int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) for d in few.doc_id]
    taken = sorted(x for x, c in zip(u, few.copies) if c)
    assert max(taken) <= sorted(u)[len(taken) + 1]


def test_growing_the_tree_moves_rows_into_new_shards_only(spark, docs):
    ids = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    leaves = sharding.tree(40)
    a = sharding.sharded(ids, leaves, sharding.grown(leaves)).toPandas()
    assert set(a[a.shard != a.grown_shard].grown_shard) == {40} and 50 < (a.grown_shard == 40).sum() < 160
    assert a.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all() and a["shard"].nunique() == 40
    two = sharding.sharded(ids, sharding.grown(leaves), sharding.grown(leaves, 2)).toPandas()
    assert set(two[two.shard != two.grown_shard].grown_shard) == {41}
    heavier = [sharding.Leaf(x.region, x.rack, 3.0 if i == 0 else 1.0) for i, x in enumerate(leaves)]
    moved = sharding.sharded(ids, leaves, heavier).toPandas()
    moved = moved[moved.shard != moved.grown_shard]
    assert (moved.grown_shard < 20).all()
    odd = sharding.sharded(docs, leaves).toPandas()
    assert len(odd) == docs.count() and odd.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert sharding.sharded(docs.limit(0), leaves).count() == 0


def test_every_stage_and_the_whole_pipeline(spark, tmp_path):
    """Each stage against what its operator says of its own input, and the chain on a table of odd rows."""
    passage = " ".join(f"w{i}" for i in range(90))
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    more = [(300, passage, "en", "a"), (301, passage + " end", "en", "a"), (302, " ".join(f"v{i}" for i in range(70)) + f' token = "{key}" x', "en", "b")]
    docs = table(spark, more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(d, 1, 0) for d in (*range(40), 300, 301, 302)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, now, sf), name)
        assert out.columns == corpus_pipeline.COLUMNS
        kept[name] = (now, out)
        now = out
    before, after = kept["quality"]
    verdicts = quality.judged(before.select(corpus_pipeline.COLUMNS), spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(map(str, after.collect())) == sorted(str(x.row) for x in verdicts.collect() if x.kept)
    before, after = kept["near_dedup"]
    sets = {}
    for x in before.collect():
        w = (x.text or "").lower().split()
        sets[x.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    stay = [d for d in sets if d is None or not any(e is not None and e < d and 100 * len(sets[d] & sets[e]) >= 85 * len(sets[d] | sets[e]) for e in sets)]
    assert {x.doc_id for x in after.collect()} == set(stay) and 300 in stay and 301 not in stay
    before, after = kept["secrets"]
    assert all(key not in x.text and secrets.MARK in x.text for x in after.where("doc_id = 302").collect()) and after.count() == before.count()
    before, after = kept["mixing"]
    copies = {(x.doc_id, x.crc): x.copies for x in mixing.mixed(before).collect()}
    got = {}
    for x in after.collect():
        k = (x.doc_id, zlib.crc32((x.text or "").encode()))
        got[k] = got.get(k, 0) + 1
    seen = {}
    for x in before.collect():
        k = (x.doc_id, zlib.crc32((x.text or "").encode()))
        seen[k] = seen.get(k, 0) + 1
    assert got == {k: n * copies[k] for k, n in seen.items() if copies[k]}
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    tokens = packing.packed(after).toPandas()
    assert sorted(pieces.ids_crc32) == sorted(tokens.ids_crc32) and pieces.length.sum() == tokens.length.sum()
    assert neardup.components(docs.limit(0)).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    table(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
