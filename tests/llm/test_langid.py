"""Language identification: the learner and the prediction against plain Python, accuracy, and odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import langid

WORDS = {"en": "the and that with from this there been", "de": "der und nicht mit auch eine sich über", "fr": "le les une dans pour avec être été", "es": "el los una para con está más niño"}


def data(n=200):
    r = random.Random(1)
    langs = sorted(WORDS)
    return [(i, " ".join(r.choice(WORDS[langs[i % 4]].split()) for _ in range(30)), langs[i % 4]) for i in range(n)]


def test_ftrl_against_plain_python():
    r = random.Random(2)
    rows = [(np.array(sorted(r.sample(range(12), 4))), np.array([r.uniform(0.1, 2) for _ in range(4)])) for _ in range(40)]
    labels = np.array([r.randrange(3) for _ in rows])
    got = langid.fit_ftrl(rows, labels, 3, epochs=3)
    z, n = {}, {}

    def weight(f, k):
        x = z.get((f, k), 0.0)
        if abs(x) <= langid.L1:
            return 0.0
        return -(x - math.copysign(langid.L1, x)) / ((langid.BETA + math.sqrt(n.get((f, k), 0.0))) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(len(rows)):
            s = [sum(x * weight(f, k) for f, x in zip(*rows[i])) for k in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            w = {(f, k): weight(f, k) for f in rows[i][0] for k in range(3)}
            for f, x in zip(*rows[i]):
                for k in range(3):
                    g = x * (e[k] / sum(e) - (labels[i] == k))
                    old = n.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w[f, k]
                    n[f, k] = old + g * g
    assert np.allclose(got[:12], [[weight(f, k) for k in range(3)] for f in range(12)], atol=1e-6) and not got[12:].any()


def test_ngrams_cover_the_whole_text():
    a, b = langid._hashed("Ab 1c"), langid._hashed("ab!!c")
    assert a.tolist() == b.tolist() and len(a) == 6 + 5 + 4  # " ab c ": 6 single characters, 5 pairs, 4 triples
    assert not langid._hashed("12 !!").size and langid._hashed("x" * 100_000).size == 3 * 100_002 - 3


@pytest.fixture(scope="module")
def trained(spark):
    rows = data()
    extra = [(900, None, "en"), (901, "12 !!", "en"), (902, "", None), (903, None, None), (None, "the and that", "en")]
    df = spark.createDataFrame([(*x, 1.0, "x") for x in rows + extra], "doc_id long, text string, lang string, score double, most string")
    return df, langid.train(df.where(~langid.held_out(df.doc_id)).select("doc_id", "text", "lang"))


def test_accuracy_and_undetermined_rows(trained):
    df, model = trained
    got = {x.doc_id: x for x in langid.predicted(df.select("doc_id", "text"), model).collect()}
    held = [(d, k) for d, _, k in data() if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(held) > 20 and sum(got[d].lang_pred == k for d, k in held) >= 0.95 * len(held) and all(0 <= x.score <= 1 for x in got.values())
    assert {(got[d].lang_pred, got[d].score) for d in (900, 901, 902, 903)} == {("und", 0.0)} and got[None].lang_pred == "en"
    assert (model[1] == 0).mean() > 0.5 and model[0] == sorted(WORDS)


def test_prediction_by_hand_and_very_long_texts(spark, trained):
    _, (langs, table) = trained
    texts = ["the und les", "être " * 60_000, "und"]
    got = {x.doc_id: x for x in langid.predicted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (langs, table)).collect()}
    for i, t in enumerate(texts):
        s = table[langid._hashed(t)].astype(float).mean(0)
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert got[i].lang_pred == langs[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-6


def test_many_languages_and_none(spark):
    rows = [(i, f"{chr(97 + i % 80 // 26)}{chr(97 + i % 80 % 26)} " * 8, f"l{i % 80}") for i in range(480)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, _ = langid.train(df)
    assert len(langs) == 80
    assert langid.train(df.limit(0)) is None
    assert {(x.lang_pred, x.score) for x in langid.predicted(df.select("doc_id", "text").limit(3), None).collect()} == {("und", 0.0)}
