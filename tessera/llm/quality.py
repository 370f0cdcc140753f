"""Quality rules: surface rules, then a hashed n-gram log-likelihood ratio of trusted target and raw corpus.

Words and neighbouring word pairs are hashed into ``buckets``. Two multinomials over the buckets are counted: one over
every document, one over the trusted documents. With f the trusted share of all n-grams, a bucket's log ratio is
ln((trusted / f + prior) / (raw + prior)), kept as a whole number of 1e-4 nats so that sums are exact and reruns agree.
A document passes when its mean log ratio per n-gram is at least ``threshold``.

Everything runs as DataFrame expressions. The raw counts cover all documents. The trusted multinomial is fitted on at
most ``trusted_limit`` trusted documents (those with the smallest md5 of the id), which bounds the broadcast of ids;
the table of log ratios has ``buckets`` entries whatever the input, and is a literal in the second pass.

Null or empty texts have no words: base_failed is true, kept false. Without trusted documents every ratio is 0 and the
surface rules alone decide. Repeated rows are judged alike; each row gets a verdict. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

BUCKETS = 1 << 18
PRIOR = 8.0
THRESHOLD = -0.2
TRUSTED_LIMIT = 20_000
SYMBOLS = "#*$%&|<>"
#: Multiplier that joins the hashes of a pair.
PAIR = 1_000_003
#: Log ratios are kept as whole multiples of 1 / SCALE nats.
SCALE = 10_000


def with_hashes(df: DataFrame) -> DataFrame:
    """Append _c, the CRC-32 of the words in _w, and _p, the hashes of the pairs of neighbouring words."""
    df = df.withColumn("_c", F.transform("_w", lambda x: F.crc32(x.cast("binary"))))
    pairs = F.zip_with("_c", F.slice("_c", 2, F.greatest(F.size("_c"), F.lit(1))), lambda a, b: a * PAIR + b)
    return df.withColumn("_p", F.slice(pairs, 1, F.greatest(F.size("_c") - 1, F.lit(0))))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """To rows with a text, _w, _c and _p append the counts of the surface rules (long) and base_failed.

    Repeated 3-word windows (two neighbouring pairs) are found by sorting their hashes with their positions; the words
    that they cover are then counted from the gaps between the positions.
    """
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    out = (
        df.withColumn("_lines", lines)
        .withColumn("_h", F.slice(windows, 1, F.greatest(F.size("_p") - 1, F.lit(0))))
        .withColumn("_r", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    )
    twice = F.filter("_r", lambda x, k: (x["h"] == F.get("_r", k - 1)["h"]) | (x["h"] == F.get("_r", k + 1)["h"]))
    out = out.withColumn("_at", F.when(F.col("_r").isNull(), F.array().cast("array<int>")).otherwise(F.sort_array(F.transform(twice, lambda x: x["i"]))))
    steps = F.transform("_at", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("_at", k - 1), p - 3)))
    return out.select(
        *df.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """Ids of at most ``limit`` documents that are labelled good, by the md5 of the id."""
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    return ids.orderBy(F.md5(F.col("trusted_id").cast("string")), "trusted_id").limit(limit)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row: ``ratios``, the scaled log ratios of every bucket in order, joined by commas. docs: (doc_id, text)."""
    marked = docs.join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
    counts = (
        with_hashes(marked.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), common.words(F.col("text")).alias("_w")))
        .select("t", F.explode_outer(F.concat("_c", "_p")).alias("h"))  # outer: else a size filter goes below and computes both anew
        .where("h is not null")
        .groupBy((F.col("h") % buckets).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("t"))
    )
    every = docs.sparkSession.range(buckets).join(counts, F.col("id") == F.col("bucket"), "left")
    listed = every.select("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("t", F.lit(0)).alias("t")).agg(
        F.sort_array(F.collect_list(F.struct("id", "raw", "t"))).alias("c"), F.sum("raw").alias("n"), F.sum("t").alias("nt")
    )
    share = F.col("nt").cast("double") / F.col("n")
    return listed.select(
        F.array_join(F.transform("c", lambda x: F.when(F.col("nt") > 0, F.round(F.ln((x["t"] / share + prior) / (x["raw"] + prior)) * SCALE)).otherwise(0.0).cast("int")), ",").alias("ratios")
    )


def judged(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    prior: float = PRIOR,
    threshold: float = THRESHOLD,
    trusted_limit: int = TRUSTED_LIMIT,
) -> DataFrame:
    """Every row of docs as ``row`` (a struct of all its columns) with doc_id, the features, llr_sum, n_grams and kept."""
    listed = log_ratios(common.pick(docs), trusted_ids(labels, trusted_limit), buckets, prior).first()[0]
    table = F.split(F.lit(listed), ",").cast("array<int>")  # folded to one literal of fixed size
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    out = features(with_hashes(rows.withColumn("_w", common.words(F.col("text")))))
    ratio = lambda a, h: a + F.get(table, (h % buckets).cast("int"))
    out = out.withColumn("llr_sum", F.aggregate("_c", F.lit(0).cast("long"), ratio) + F.aggregate("_p", F.lit(0).cast("long"), ratio))
    out = out.withColumn("n_grams", (F.size("_c") + F.size("_p")).cast("long"))
    passed = F.col("llr_sum") >= F.lit(round(threshold * SCALE)) * F.col("n_grams")
    return out.withColumn("kept", ~F.col("base_failed") & passed).drop("_w", "_c", "_p", "text")


def kept_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that pass, with their own columns."""
    # A filter that needs the row's number stays above the verdict; pushed down, it would compute the verdict's parts anew.
    numbered = judged(docs, labels, **options).withColumn("_n", F.monotonically_increasing_id())
    return numbered.where("kept AND _n >= 0").select("row.*")


def op4_quality_ratio(spark, sf_dir: str) -> DataFrame:
    out = judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_sum", "n_grams")


#: CRC-32 of words in DuckDB: the table of the polynomial, then a fold over the bytes.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab"


def crc32_sql(text: str, tab: str) -> str:
    byte = f"('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_transform(range(strlen({text})), lambda i: {byte}), lambda c, b: xor({tab}[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"


OP4_SQL = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(str_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
tok AS MATERIALIZED (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
vocab AS MATERIALIZED (SELECT word, {crc32_sql('word', 'tab')} AS h FROM (SELECT DISTINCT word FROM tok), crc),
hashed AS MATERIALIZED (SELECT r, pos, h, lead(h) OVER (PARTITION BY r ORDER BY pos) AS h2 FROM tok JOIN vocab USING (word)),
grams AS MATERIALIZED (
  SELECT r, h % {BUCKETS} AS b FROM hashed
  UNION ALL SELECT r, (h * {PAIR} + h2) % {BUCKETS} FROM hashed WHERE h2 IS NOT NULL),
trusted AS (
  SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {TRUSTED_LIMIT}),
counts AS (SELECT b, count(*) AS raw, count(*) FILTER (WHERE d.doc_id IN (SELECT doc_id FROM trusted)) AS t FROM grams JOIN d USING (r) GROUP BY b),
sums AS (SELECT sum(raw) AS n, sum(t) AS nt FROM counts),
ratio AS (
  SELECT b, CASE WHEN nt > 0 THEN round(ln((t / (nt::DOUBLE / n) + {PRIOR}) / (raw + {PRIOR})) * {SCALE})::BIGINT ELSE 0 END AS v FROM counts, sums),
llr AS (SELECT r, sum(v)::BIGINT AS llr_sum, count(*) AS n_grams FROM grams JOIN ratio USING (b) GROUP BY r),
win AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, a, b, c) AS k
  FROM (SELECT r, pos, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM tok WINDOW w AS (PARTITION BY r ORDER BY pos))
  WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS p FROM win WHERE k > 1) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(str_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(llr_sum, 0)::BIGINT AS llr_sum, coalesce(n_grams, 0)::BIGINT AS n_grams
  FROM d LEFT JOIN lines USING (r) LEFT JOIN rep USING (r) LEFT JOIN llr USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND llr_sum >= {round(THRESHOLD * SCALE)} * n_grams AS kept, llr_sum, n_grams
FROM base
"""
