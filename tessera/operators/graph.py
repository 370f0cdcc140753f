"""Connected components over a table of links, per mesh."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """Write df once to the folder in spark.checkpoint.dir (where it is unset and all run in one process, a temporary one) and read it back."""
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(context, "_tessera_scratch", None)
        if root is None:
            root = context._tessera_scratch = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
    path = f"{root.rstrip('/')}/mesh-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing that is still to run reads it."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(mesh_id, node, label) of nodes(mesh_id, node): the least node reachable over links(mesh_id, a, b).

    Labels take the least of their neighbours' and are then followed twice; rounds are written out, until none changes.
    """
    both = stored(links.where("a <> b").select("mesh_id", F.expr("inline(array(struct(a, b), struct(b AS a, a AS b)))")).distinct())
    held = labels = stored(nodes.select("mesh_id", "node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), ["mesh_id", "b"]).groupBy("mesh_id", F.col("a").alias("node")).agg(F.min("label").alias("m"))
        met = labels.join(near.hint("merge"), ["mesh_id", "node"], "left").select("mesh_id", "node", "label", F.least("label", "m").alias("m"))
        for k in range(2):
            up = labels.select("mesh_id", F.col("node").alias("m"), F.col("label").alias(f"u{k}"))
            met = met.join(up.hint("merge"), ["mesh_id", "m"]).select("mesh_id", "node", "label", F.least("m", f"u{k}").alias("m"))
        new = stored(met.select("mesh_id", "node", F.col("m").alias("label"), (F.col("m") < F.col("label")).alias("moved")))
        discard(held)
        held, labels = new, new.drop("moved")
        if new.where("moved").isEmpty():
            discard(both)
            return labels
