"""Packing: token ids against the tokenizer as it loads, layout, and the BM25 choice of neighbours against brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_ids_are_those_of_the_tokenizer(tokenizer):
    r = random.Random(1)
    texts = ["hello <|endoftext|> world", "<|startoftext|>x<|endoftext|><|endoftext|>y it's <| |>", "It's A b\x1cc ÉCOLE é 12ab!!'s", "ΣΑΣ İx ²³", "", "a b c d　e\x85f"]
    texts += ["日本語 한국어 123", "é É'S don't 'S 'll", "\n \t", "ﬁ Å ſ ß", "À×Þ÷ÿ ÀÞ ß9é", "12 3a4b5 6", "x" * 300_000, "ab 1! " * 50_000]
    pool = "aB1 '!<|>éΣİ́  \x1c\x85日  \n's9×ÀÞß"
    texts += ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(800)]
    e = packing.WordEncoder(packing.default_tokenizer())
    for _ in range(2):  # new pieces, then known ones
        got = [x for i in range(0, len(texts), 40) for x in e.ids(texts[i : i + 40])]
        assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_tables_of_pieces_forget_but_do_not_err(tokenizer, monkeypatch):
    monkeypatch.setattr(packing.WordEncoder, "SLOTS", 4)
    monkeypatch.setattr(packing, "CACHE", 60)
    e, r = packing.WordEncoder(packing.default_tokenizer()), random.Random(2)
    for _ in range(30):
        texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in e.ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def brute_windows(sizes, docs, idf, mean, window):
    """The same greedy rule with dictionaries."""

    def bm25(seed, d):
        n = len(docs[d])
        return sum(idf[t] * docs[d].count(t) * 2.2 / (docs[d].count(t) + 1.2 * (0.25 + 0.75 * n / mean)) for t in set(docs[seed]) if t in docs[d])

    left, begin, out, carry = set(range(len(docs))), [0] * len(docs), [], None
    while left or carry is not None:
        seed = carry if carry is not None else min(left, key=lambda d: (-sizes[d], d))
        left.discard(seed)
        carry, got, room = None, [(seed, begin[seed], sizes[seed])], window - sizes[seed] + begin[seed]
        score = {d: bm25(seed, d) for d in left}
        while room and left:
            fits = [d for d in left if sizes[d] <= room] or list(left)
            best = max(fits, key=lambda d: (score[d], -d))
            left.discard(best)
            took = min(room, sizes[best])
            got.append((best, 0, took))
            room -= took
            if took < sizes[best]:
                begin[best], carry = took, best
        out.append(got)
    return out


def test_neighbours_against_brute_force():
    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(r.choices(vocabulary[k % 60 : k % 60 + 25], k=r.randint(3, 60))) for k in range(70)]
    docs = [re.findall("[a-z]+", t) for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    idf = {t: math.log1p((n - f + 0.5) / (f + 0.5)) for t in vocabulary for f in [sum(t in d for d in docs)]}
    terms = packing._terms([t.encode() for t in texts])
    weights = np.zeros(packing.TERMS)
    for d, cells in zip(docs, terms):
        assert len(d) == len(cells)
        weights[cells] = [idf[t] for t in d]
    sizes = np.array([min(99, 2 * len(d) + 1) for d in docs])
    assert len({int(c) for x in terms for c in x}) == len({t for d in docs for t in d})
    assert packing.pack_shard(sizes, terms, weights, mean, 128) == brute_windows(sizes.tolist(), docs, idf, mean, 128)


def checked(tokenizer, rows, got, window):
    for d, x in rows:
        ids = np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        mine, at = got[got.doc_id == d].sort_values("start"), 0
        for p in mine.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    q = got.sort_values(["sequence_id", "offset"])
    full = q.groupby("sequence_id").length.sum()
    assert (q.offset == q.groupby("sequence_id").length.cumsum() - q.length).all() and full.max() <= window
    return full


def test_pieces_do_not_depend_on_partitions(spark, tokenizer):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(("Word", "été", "12", "it's", "z!")) + str(r.randint(0, 99)) for _ in range(r.randint(0, 90)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "w " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (packing.packed(df.repartition(k), window=256, shard_rows=64).toPandas().sort_values(["sequence_id", "offset"]).reset_index(drop=True) for k in (2, 7))
    assert a.equals(b)
    full = checked(tokenizer, rows, a, 256)
    assert (full < 256).sum() <= 2 * (a.sequence_id // (1 << 32)).nunique()


def test_hot_shards_nulls_and_clashing_names(spark, tokenizer):
    rows = [(7, "the same text " * 9, 1, 2)] * 150 + [(None, "no id", 1, 2), (8, "x", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, crc long")
    got = packing.packed(df, window=128, shard_rows=16).toPandas()
    assert got.length.sum() == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t, *_ in rows) and got.doc_id.isna().sum() == 1
    assert packing.packed(df.limit(0)).count() == 0
