"""Secret scans: candidate strings, then a random forest that removes false positives.

Candidates are whole private key blocks, the passwords of links, values of 8 characters or more that follow a name like ``password`` and an
equals sign or colon, or ``Bearer``, and runs of at least ``SHORTEST`` characters of keys and tokens that aren't plain words.
The forest looks at a candidate's length, character classes and transitions between them, entropy, the share of it
that dictionary words cover, the words before and after it, and the path it comes from. The dictionary is that of the corpus: its
words of letters in ``LEAST_ROWS`` rows or more, of which the most frequent make up at most ``DICTIONARY`` words. The forest is trained on labelled findings
(``labelled``): generated secrets in assignments, headers and links, and generated look-alikes such as digests, ids,
numbers, addresses and placeholders; other labelled findings may be given. Candidates that score ``THRESHOLD`` or more are secrets.

Null and empty texts have no findings; a null path is an empty one; whole texts are read, whatever their length, in linear time; equal rows
give equal findings; equal counts of words all stay in the dictionary or all leave; an empty table gives an empty result; further columns are ignored (redaction keeps them).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, forest

SHORTEST, SHORT, THRESHOLD = 16, 8, 0.5
LEAST_ROWS, DICTIONARY = 3, 20_000
MARK = "[SECRET]"
RUN = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")
BEGIN, END = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
VALUE = re.compile(r"""(?::=|=>|=|:|\b[Bb]earer[ \t])[ \t]{0,3}["'`]?([^\s"'`,;<>(){}\[\]]{8,})""")
LINK = re.compile(r"://[^\s/:@]{1,64}:([^\s/:@]{4,200})@")
NAMED = re.compile(r"""([A-Za-z][\w-]*)["'`]?[ \t]{0,3}\Z""")
WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]{4,14}(?![A-Za-z])")
HINTS = frozenset("token secret password passwd pwd key apikey api_key auth authorization bearer credential credentials private access_token client_secret".split())
HARMLESS = frozenset("commit sha sha1 sha256 md5 checksum digest uuid guid id hash etag version build revision from order card account phone isbn serial trace request".split())
PLACEHOLDER = frozenset("example sample dummy placeholder test fake changeme your redacted".split())
RISKY_PATH, CALM_PATH = re.compile(r"\.env|config|secret|credential|\.pem|settings|deploy"), re.compile(r"test|spec|doc|lock|example|fixture|vendor")
#: Starts that issuers give to their tokens; fixed values.
STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ", "npm_", "SG.")
FEATURES = 19


def dictionary(docs: DataFrame, least: int = LEAST_ROWS, size: int = DICTIONARY) -> frozenset[str]:
    """The lower-cased words of 4 to 14 letters that at least ``least`` rows hold, of docs (text); if they are over ``size``, the
    least is doubled until they aren't."""

    def run(batches):
        seen: Counter[str] = Counter()
        for b in batches:
            for x in b.column(0):
                seen.update(set(map(str.lower, WORD.findall(x.as_py() or ""))))
            if len(seen) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = common.stored(counts, "words")
    # words by the number of doublings of the least that they reach: a few rows
    steps = counts.groupBy(F.floor(F.log2(F.col("n") / F.lit(least))).alias("k")).count().collect()
    reach, k = 0, max((r["k"] for r in steps), default=0)
    while k >= 0 and reach + sum(r["count"] for r in steps if r["k"] == k) <= size:
        reach += sum(r["count"] for r in steps if r["k"] == k)
        k -= 1
    words = frozenset(r["word"] for r in counts.where(F.floor(F.log2(F.col("n") / F.lit(least))) > k).collect())
    common.discard(counts)
    return words


def _covered(value: str, words: frozenset[str]) -> float:
    """Share of the characters that dictionary words of four letters or more cover, longest first from the left."""
    low, at, got = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(14, len(low) - at), 3, -1):
            if low[at : at + n] in words:
                got += n
                at += n
                break
        else:
            at += 1
    return got / max(1, len(low))


def _sensitive(name: str) -> bool:
    parts = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower())
    return any(p in HINTS for p in parts) or name.lower() in HINTS


def features(text: str, start: int, end: int, path: str, words: frozenset[str]) -> list[float]:
    v = text[start:end]
    n = len(v)
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in v]
    shown = Counter(v)
    entropy = -sum(k / n * math.log2(k / n) for k in shown.values())
    before, after = text[max(0, start - 60) : start], text[end : end + 40]
    prior = re.findall(r"[a-z0-9_]+", before.lower())[-3:]
    later = re.findall(r"[a-z0-9_]+", after.lower())[:3]
    tail = before.rstrip("\"'` ")
    name = NAMED.search(tail.rstrip(":=> \t")[-45:])
    return [
        n,
        len(shown) / n,
        entropy,
        kinds.count(2) / len(kinds),
        kinds.count(1) / len(kinds),
        sum(c in "0123456789abcdefABCDEF" for c in v) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(kinds) - 1),
        max(map(len, re.findall(r"[A-Za-z]+", v)), default=0) / n,
        _covered(v, words),
        float(v.startswith(STARTS) or v.startswith("-----BEGIN")),
        float(tail.endswith(("=", ":", ":=", "=>"))),
        float(any(_sensitive(w) for w in prior)),
        float(bool(name) and tail.endswith(("=", ":", ">")) and _sensitive(name[1])),
        sum(not c.isalnum() for c in v) / n,
        float(any(w in HARMLESS for w in prior)),
        float(any(w in PLACEHOLDER for w in (*prior, *later)) or bool(re.search(r"example|xxxx|0000|1234", v, re.I))),
        float(v.count(".")),
        float(bool(RISKY_PATH.search(path.lower()))) - float(bool(CALM_PATH.search(path.lower()))),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before) and bool(after)),
    ]


def _shaped(v: str) -> bool:
    """Whether a run is more than words joined by signs: it has a digit, or changes from lower to upper case within a word twice."""
    return any(c.isdigit() for c in v) or sum(a.islower() and b.isupper() for a, b in zip(v, v[1:])) >= 2


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in ".-/":
        end -= 1
    return start, end


def spans(text: str) -> list[tuple[int, int]]:
    """The candidates (start, end), in order and apart; of overlapping ones blocks and values come before runs, then the one that starts first."""
    found, at = [], 0
    while (m := BEGIN.search(text, at)) and (e := END.search(text, m.end())):
        found.append((m.start(), 0, e.end()))
        at = e.end()
    for m in LINK.finditer(text):
        found.append((m.start(1), 1, m.end(1)))
    for m in VALUE.finditer(text):
        name = NAMED.search(text[max(0, m.start() - 45) : m.start()])
        if text[m.start()] in "bB" or (name and _sensitive(name[1])):
            a, b = _trimmed(text, m.start(1), m.end(1))
            if b - a >= SHORT:
                found.append((a, 1, b))
    for m in RUN.finditer(text):
        a, b = _trimmed(text, *m.span())
        while a < b and text[a] in "=./-" and not text.startswith("-----", a):
            a += 1
        if b - a >= SHORTEST and _shaped(text[a:b]):
            found.append((a, 2, b))
    out: list[tuple[int, int]] = []
    for runs in (False, True):
        kept, k, upto = [], 0, -1
        for a, kind, b in sorted(x for x in found if (x[1] == 2) == runs):
            while k < len(out) and out[k][1] <= a:
                k += 1
            if a >= upto and (k == len(out) or b <= out[k][0]):
                kept.append((a, b))
                upto = b
        out = sorted(out + kept)
    return out


def labelled(count: int = 5000, seed: int = 5, words: frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Generated findings: features and labels, as many of either kind. words: the dictionary."""
    r, listed = random.Random(seed), sorted(words)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    made = lambda: of("abcdehilnorstu", r.randint(2, 9))
    word = lambda: r.choice(listed) if listed and r.random() < 0.7 else made()
    secret = (
        lambda: of("0123456789abcdef", r.choice((32, 40, 40, 40, 64))),
        lambda: of(alnum, r.randint(16, 64)),
        lambda: of(alnum + "+/", 40),
        lambda: of(alnum[:52], r.randint(16, 40)),
        lambda: r.choice(STARTS) + of(alnum, r.randint(16, 40)),
        lambda: "eyJ" + of(alnum, 30) + "." + of(alnum, 60) + "." + of(alnum + "_-", 43),
    )
    short = (
        lambda: of(alnum + "!@#$%^&*?", r.randint(8, 15)),
        lambda: word() + of("0123456789", r.randint(1, 4)) + r.choice(("", "!", "#", "secret", made())),
        lambda: r.choice("PpSsAaQq") + of("@$0135!", 2) + made() + of("0123456789!#", 3),
        lambda: word().capitalize() + r.choice("-_.") + word().capitalize() + of("0123456789", r.randint(1, 3)),
    )
    named = ("token", "api_key", "secret", "password", "client_secret", "aws_secret_key", "Authorization: Bearer", "access_token", "auth", "passwd", "dbPassword", "API_TOKEN")
    innocent = (
        lambda: of("0123456789", r.randint(16, 19)),
        lambda: ".".join(str(r.randint(100, 255)) for _ in range(4)) + "." + str(r.randint(10, 99)),
        lambda: "-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: "_".join(word() for _ in range(4)) + str(r.randint(1, 99)),
        lambda: "/".join(word() for _ in range(5)) + f"/{r.randint(1, 2025)}",
        lambda: of("0123456789abcdef", r.choice((32, 40, 64))),
        lambda: word() + "." + of("0123456789", 2) + "." + word() + "." + word() + ".com",
        lambda: r.choice(("xxxxxxxxxxxxxxxx0000", "your_api_key_12345678", "example1234567890abcdef", "0000000000000000", "changeme_changeme_1234")),
        lambda: "-" * r.randint(12, 30) + of("0123456789", 4) + "-" * 4,
        lambda: "v" + ".".join(str(r.randint(0, 20)) for _ in range(3)) + "-" + word() + "." + of("0123456789", 8),
        lambda: r.choice((word, lambda: word() + word(), lambda: word() + "_" + word(), lambda: word() + "-" + word()))() or "required",
        lambda: r.choice(("${TOKEN}", "********", "changeme", "placeholder", "required", "undefined", "process.env.TOKEN", "os.environ", "config.password", "$PASSWORD", "YOUR_TOKEN", "redacted", "see-below")),
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + r.choice(("", "2", "V1")),
        lambda: made() + word() + "." + of("0123456789", 2),
    )
    rows, labels = [], []
    while len(labels) < count:
        good = len(labels) % 2 == 0
        left, right = " ".join(word() for _ in range(r.randint(0, 6))), " ".join(word() for _ in range(r.randint(0, 6)))
        path = r.choice(("", "", "src1", "web", "config/prod.env", "docs/a.md", "tests/x.py", "app/settings.py"))
        if good:
            brief = r.random() < 0.3
            v, name = r.choice(short if brief else secret)(), r.choice(named)
            text = r.choice((f'{left} {name} = "\0" {right}', f"{left} {name}: \0\n{right}", f"{left} {name}=\0 {right}", f"{left} '{name}': '\0', {right}", f'{left} {name} => "\0"### {right}'))
            if brief and r.random() < 0.15:
                text = f"{left} postgres://{made()}:\0@{made()}/{made()} {right}"
            elif not brief and r.random() < 0.1 and v.startswith(STARTS):
                text = f"{left} \0 {right}"
        else:
            k = r.randrange(len(innocent))
            v = innocent[k]()
            name = r.choice(("commit", "sha256", "checksum", "md5", "uuid", "etag", "build", "revision", "id")) if k in (2, 5) else r.choice(named) if k in (7, 10, 11) else word()
            text = r.choice((f"{left} {name} \0 {right}", f"{left} {name}: \0 {right}", f'{left} {name} = "\0" {right}')) if k not in (7, 10, 11) else r.choice((f'{left} {name} = "\0" {right}', f"{left} {name}: \0 {right}"))
            if k == len(innocent) - 1:
                text = f"{left} \0@{made()}{r.randint(0, 9)}.{word()}.{r.choice(('com', 'org', 'net'))} {right}"
        at = text.index("\0")
        text = text.replace("\0", v)
        rows.append(features(text, at, at + len(v), path, words))
        labels.append(good)
    return np.array(rows), np.array(labels)


class Model(NamedTuple):
    """The forest and the dictionary of its features: both of bounded size."""

    trees: list
    words: frozenset


def train(words: frozenset[str] = frozenset(), findings: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """A model of generated findings, and of further labelled ones (features, labels) if there are any."""
    x, y = labelled(words=words)
    if findings is not None:
        x, y = np.concatenate((x, findings[0])), np.concatenate((y, findings[1]))
    return Model(forest.fit(x, y, trees=40, depth=12), words)


def scored(texts: list[str], paths: list[str], model: Model) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of the candidates of each text."""
    found = [spans(t) for t in texts]
    x = [features(t, a, b, p, model.words) for t, p, s in zip(texts, paths, found) for a, b in s]
    scores = iter(forest.predict(model.trees, np.array(x)).tolist() if x else ())
    return [[(a, b, next(scores)) for a, b in s] for s in found]


def findings(docs: DataFrame, path_col: str = "source", model: Model | None = None) -> DataFrame:
    """One row per candidate: doc_id, start and end (code points), length, value_sha256, score, secret."""
    common.byte_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(dictionary(docs)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))

    def run(batches):
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for d, t, s in zip(b.column(0).to_pylist(), texts, scored(texts, b.column(2).to_pylist(), shared.value)):
                out += [(d, x, y, y - x, hashlib.sha256(t[x:y].encode()).hexdigest(), p, p >= THRESHOLD) for x, y, p in s]
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], _SCHEMA)

    return rows.mapInArrow(run, "doc_id long, start long, end long, length long, value_sha256 string, score double, secret boolean")


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("length", pa.int64()), ("value_sha256", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())]
)


def redacted(docs: DataFrame, path_col: str = "source", model: Model | None = None) -> DataFrame:
    """docs with every secret in text replaced by MARK (and n_chars, if there is one, counted anew)."""
    common.byte_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(dictionary(docs)))

    @F.pandas_udf("string")
    def clean(text, path):
        texts = ["" if t is None else t for t in text]
        out = []
        for t, s, was in zip(texts, scored(texts, ["" if p is None else p for p in path], shared.value), text):
            for a, b, p in reversed(s):
                if p >= THRESHOLD:
                    t = t[:a] + MARK + t[b:]
            out.append(None if was is None else t)
        return _series(out)

    out = docs.withColumn("text", clean(F.col("text"), F.col(path_col).cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def _series(values):
    import pandas as pd

    return pd.Series(values, dtype=object)


def op9_secret_forest(spark, sf_dir: str) -> DataFrame:
    return findings(common.table(spark, sf_dir, "documents"))
