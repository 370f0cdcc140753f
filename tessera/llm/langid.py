"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to ``ORDERS`` letters (lower case, runs of anything else as one space) are hashed into ``FEATURES`` cells. A
text's features are the shares of its n-grams times their inverse document frequencies. The weights are fitted by
follow-the-regularised-leader (FTRL-proximal) with an elastic net, which sets most of them to exactly zero; a temperature
is then fitted on rows kept apart. As the shares are linear, a prediction adds up one table row per n-gram of the whole text.

Document frequencies are counted over every training row. The classifier is fitted on a bounded sample of training rows:
about ``PER_LANG`` of each language, by the md5 of the id. Every language of a training row can be predicted; the
table of weights has ``FEATURES`` numbers for each.
Held-out rows (crc32(doc_id) mod 4 = 2) are never read for training; lang, source and doc_id are no inputs of a prediction.

Null texts and texts without a letter give ``und`` with score 0, and so does everything when there are no training rows.
Ties go to the language that is first by code point. Whole texts are read, very long ones in steps of ``STEP`` n-grams. Repeated rows get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

ORDERS = 3
FEATURES = 1 << 16
PER_LANG, STEP = 800, 40_000
EPOCHS = 4
#: FTRL: step size, smoothing, and the elastic net's two parts.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-5, 1e-6
#: Shares are multiplied by this, so that gradients have a useful size.
GAIN = 20.0


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text with runs of non-letters as one space, a space at each end."""
    low = text.lower()
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(a, len(_LETTER) - 1)]
    if a.size and a.max() >= len(_LETTER):
        far = np.nonzero(a >= len(_LETTER))[0]
        letter[far] = [chr(c).isalpha() for c in a[far].tolist()]
    a = np.where(letter, a, 32)
    keep = np.ones(a.size, bool)
    keep[1:] = letter[1:] | letter[:-1]
    a = a[keep]
    if a.size and a[0] == 32:
        a = a[1:]
    if a.size and a[-1] == 32:
        a = a[:-1]
    return np.concatenate(([32], a, [32])).astype(np.uint32) if a.size else a.astype(np.uint32)


_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def _hashed(text: str) -> np.ndarray:
    """The cell of every n-gram of the whole text; empty if it has no letter."""
    a = _codes(text)
    if not a.size:
        return np.zeros(0, np.int64)
    out, h = [], np.zeros(a.size, np.uint32)
    for n in range(ORDERS):
        if a.size <= n:
            break
        h = (h[: a.size - n] + a[n:] + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(16))
    return np.concatenate(out)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts with a letter that hold each cell, and their number, over all of docs (text); FEATURES entries."""

    def run(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for x in b.column(0):
                cells = _hashed(x.as_py() or "")
                if cells.size:
                    seen = np.zeros(FEATURES, bool)
                    seen[cells] = True
                    df += seen
                    n += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["cell", "df"])

    rows = docs.mapInArrow(run, "cell long, df long").groupBy("cell").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(FEATURES, np.int64)
    real = rows[rows["cell"] >= 0]
    df[real["cell"].to_numpy()] = real["df"].to_numpy()
    return df, int(rows.loc[rows["cell"] < 0, "df"].sum())


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights [FEATURES, classes] of (cells, values) rows, one row at a time, in a fixed shuffled order."""
    z = np.zeros((FEATURES, classes))
    n = np.zeros((FEATURES, classes))

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, over a fixed grid."""
    if not len(labels):
        return 1.0

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(len(labels)), labels] - np.log(np.exp(s).sum(1))).mean()

    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 75))
    return float(min(grid, key=loss))


def train(labelled: DataFrame, per_lang: int = PER_LANG):
    """(languages, idf * weights / temperature [FEATURES, languages]) from rows (doc_id, text, lang); None without rows."""
    known = labelled.where("lang IS NOT NULL")
    df, n = frequencies(known.select("text"))
    counts = known.groupBy("lang").count().collect()
    if not n or not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    share = {r["lang"]: min(1.0, per_lang / r["count"]) for r in counts}
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    limits = labelled.sparkSession.createDataFrame([(k, int(v * (1 << 32))) for k, v in share.items()], "lang string, most long")
    sample = known.join(F.broadcast(limits), "lang").where(u < F.col("most"))  # one row a language

    def run(batches):
        for b in batches:
            cells, numbers = [], []
            for x in b.column(1):
                c, k = np.unique(_hashed(x.as_py() or ""), return_counts=True)
                cells.append(c.astype(np.int32))
                numbers.append((k / max(1, k.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cells, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.float32()))], ["doc_id", "lang", "cells", "shares"])

    table = sample.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, cells array<int>, shares array<float>").toArrow()
    idf = np.log((n + 1) / (df + 1)) + 1
    rows, labels, apart = [], [], []
    ids, cells, shares, names = table.column("doc_id").to_pylist(), table.column("cells"), table.column("shares"), table.column("lang").to_pylist()
    for k in sorted(range(len(ids)), key=lambda k: (str(ids[k]), names[k])):
        c = cells[k].values.to_numpy(zero_copy_only=False)
        if c.size:
            rows.append((c, GAIN * idf[c] * shares[k].values.to_numpy(zero_copy_only=False)))
            labels.append(langs.index(names[k]))
            apart.append(len(rows) % 5 == 0)
    labels, apart = np.array(labels, int), np.array(apart, bool)
    if not len(labels):
        return None
    fit = np.nonzero(~apart)[0] if (~apart).any() else np.arange(len(labels))
    w = fit_ftrl([rows[i] for i in fit], labels[fit], len(langs))
    held = np.nonzero(apart)[0]
    t = fit_temperature(np.array([rows[i][1] @ w[rows[i][0]] for i in held]), labels[held])
    return langs, (GAIN * idf[:, None] * w / t).astype(np.float32)


def predicted(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score of every row of (doc_id, text)."""
    langs, table = model if model else ([], np.zeros((FEATURES, 1), np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table))  # FEATURES x languages numbers

    def run(batches):
        w = shared.value
        for b in batches:
            names, scores = [], []
            for x in b.column(1):
                cells = _hashed(x.as_py() or "") if langs else ()
                if not len(cells):
                    names.append("und")
                    scores.append(0.0)
                    continue
                s = sum(w[cells[at : at + STEP]].sum(0, dtype=np.float64) for at in range(0, len(cells), STEP)) / len(cells)
                p = np.exp(s - s.max())
                k = int(p.argmax())
                names.append(langs[k])
                scores.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_langid_ftrl(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    common.byte_batches(spark)
    model = train(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    out = predicted(common.pick(docs), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
