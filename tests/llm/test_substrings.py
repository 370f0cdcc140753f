"""Repeated passages against brute force, with and without forced collisions of hashes."""

import random

import pytest

from tessera.llm import substrings


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda n=4: "".join(r.choice("abcdefgh") for _ in range(n))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(r.randint(15, 120)) for _ in range(8)]
    out = []
    for i in range(60):
        w = text(r.randint(0, 50))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            w += p[a : r.randint(a, len(p))] if r.random() < 0.4 else p
            w += text(r.randint(0, 9))
        out.append((i + 10, " ".join(w)))
    out += [(i + 100, out[i][1]) for i in range(0, 12)]  # whole copies
    out += [(200, "la " * 400), (201, "la la di " * 60), (202, None), (203, ""), (204, "\n\t"), (205, "la " * 19), (206, "la " * 20)]
    out += [(5, out[3][1]), (5, out[3][1])]  # repeated rows of one id
    r.shuffle(out)
    return out


def brute(rows):
    seen, out = {}, {}
    for d, x in sorted(rows, key=lambda r: r[0]):
        w = (x or "").encode().split()
        stay = [True] * len(w)
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (d, i)) < (d, i):
                stay[i : i + 20] = [False] * 20
        out[d] = (len(w), stay.count(False), b" ".join(a for a, s in zip(w, stay) if s))
    return out


def result(df, bits=64):
    return {x.doc_id: (x.n_words, x.n_removed, x.kept.encode()) for x in substrings.deduplicated(df, bits).collect()}


def test_removed_words(spark):
    rows = corpus()
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


@pytest.mark.parametrize("bits", [1, 2, 6])
def test_removed_words_when_hashes_collide(spark, bits):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, bits) == brute(rows)


def test_empty_null_ids_and_clashing_names(spark):
    schema = "doc_id long, text string, m long, spans string, start int"
    assert substrings.deduplicated(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(map(str, range(40)))
    got = substrings.deduplicated(spark.createDataFrame([(None, t, 1, "s", 2), (1, t, 1, "s", 2), (2, t, 1, "s", 2)], schema)).collect()
    assert {(x.doc_id, x.n_removed) for x in got} == {(None, 0), (1, 0), (2, 40)}


def test_very_long_texts(spark):
    r = random.Random(4)
    long = " ".join(str(r.randrange(10**6)) for _ in range(120_000))
    got = result(spark.createDataFrame([(1, long), (2, "a b " + long), (3, long[: len(long) // 2])], "doc_id long, text string"))
    assert got[1][1] == 0 and got[2][:2] == (120_002, 120_000) and got[3][0] - got[3][1] <= 1
