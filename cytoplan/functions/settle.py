"""Cutting the lineage of iterated frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few columns that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def shared_path(spark: SparkSession, name: str = "") -> str:
    """A new path below the folder that driver and executors share, spark.checkpoint.dir.

    Only where neither that setting nor a checkpoint folder is set, and the session is of one machine, a folder of this machine serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="cytoplan-")
    return f"{root.rstrip('/')}/{name}{'-' if name else ''}{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of settled() that no later step reads: rounds of an iteration leave none behind."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            df._settled_at = None


def small(df: DataFrame, what: str = "rows") -> DataFrame:
    """df as a table to broadcast, behind a check of its size."""
    out = settled(df)
    if out.count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} {what}")
    return F.broadcast(out)
