"""Near-duplicates against brute force on groups of copies, chains of copies and shared passages."""

import random

import pytest

from tessera.llm import neardup


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    out = []
    for size, length in ((90, 100), (40, 200), (12, 60)):
        base = [word() for _ in range(length)]
        last = list(base)
        for i in range(size):
            w = list(last if i % 4 == 3 else base)  # every fourth one is a copy of the copy before
            for _ in range(r.randint(0, 7)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
            last = w
    passage = [word() for _ in range(80)]
    out += [" ".join([word() for _ in range(r.randint(5, 60))] + passage) for _ in range(60)]
    out += [out[0], out[0].upper(), None, "", " \n", "a b", "A b", "a b c", "x " * 500]
    return list(enumerate(out))


def brute(rows):
    sets, up = {}, {}
    for d, x in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        up[d] = d

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("small", [2, 64])
def test_components_of_groups_chains_and_passages(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rows = corpus(small)
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows)


def test_null_ids_repeated_rows_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    near = text.replace("w29", "q")
    rows = [(None, text, 1, 2), (None, text, 1, 2), (4, text, 1, 2), (4, text, 1, 2), (7, near, 1, 2), (9, "other words " * 20, 1, 2), (9, near, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, component long")
    got = sorted(((x.doc_id, x.component_id) for x in neardup.components(df).collect()), key=str)
    nine = {x for x in got if x[0] == 9}
    assert got.count((None, None)) == 2 and got.count((4, 4)) == 2 and (7, 4) in got and len(nine) == 1 and nine <= {(9, 9), (9, 4)}
    kept = neardup.kept_rows(df)
    assert kept.columns == df.columns
    ids = [x.doc_id for x in kept.collect()]
    assert ids.count(None) == 2 and ids.count(4) == 2 and 7 not in ids
    assert neardup.kept_rows(df.limit(0)).count() == 0


def test_a_very_long_text_links_with_its_copy(spark):
    r = random.Random(2)
    long = " ".join(str(r.randrange(10**6)) for _ in range(150_000))
    got = neardup.components(spark.createDataFrame([(1, long), (2, long + " end"), (3, "x")], "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 1, 3: 3}
