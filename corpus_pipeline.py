"""A corpus pipeline of five stages; each result is written as Parquet and read again as the next stage's documents.

1. quality: rows that fail the surface rules or the log-likelihood ratio go.
2. near_dedup: of each group of near copies the rows of the least id stay.
3. secrets: what the forest takes for a secret is replaced in the text.
4. mixing: rows are taken as often as the mix of sources asks for (a row may come twice).
5. packing: the pieces of the packed sequences.

Every stage but the last returns the columns of documents, whatever further columns its input has. Null and empty texts fail the
first stage; rows without an id pass the second; equal rows are treated alike; a null source is a source of its own; very long texts are rows like others; ties are settled
as the operators say; an empty table gives an empty result of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, mixing, neardup, packing, quality, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs.select(COLUMNS), common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept_rows(docs.select(COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Signatures, forests and BM25 packing are beyond SQL; tests/llm/test_rows.py holds every stage against its definition on the rows it gets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
