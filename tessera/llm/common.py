"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.ship import ship

#: Word separators: the space and U+0009 to U+000D.
WORD_SPACE = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words (runs of anything but U+0020 and U+0009 to U+000D) of a text; null gives none.

    Put it in a column of its own before it is used more than once: Spark would compute each mention anew.
    """
    flat = F.coalesce(text, F.lit(""))
    for c in WORD_SPACE:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all run in one process (tests), a
    temporary one; on a cluster that would lose rows, so it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_tessera_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext._tessera_shared = own
    return f"file://{own}"


#: Finished jobs' files and plans are let go after so many stored tables.
RELEASE = 6


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    context = df.sparkSession.sparkContext
    context._tessera_writes = getattr(context, "_tessera_writes", 0) + 1
    if context._tessera_writes % RELEASE == 0:
        release(df.sparkSession)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what stored() wrote, once nothing that is still to run reads it."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id (long) and the text (null: empty) alone, so that further columns can't clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


#: Bytes of an Arrow batch on its way to Python, where the session has no setting of its own.
BATCH_BYTES = 8 << 20


def byte_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts by bytes, unless the session has a bound; results don't depend on it. Ships this package, too."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) >= 1 << 28:
        spark.conf.set(name, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
