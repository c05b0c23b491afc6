"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

#: Everything else is part of a word; the characters are space and the ASCII controls 9 to 13.
SEPARATORS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    pieces = F.split(F.coalesce(text, F.lit("")), SEPARATORS + "+")
    return F.filter(pieces, lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names it in spark.checkpoint.dir; where that is unset, a session of this machine alone (tests) gets a folder of
    its own, and any other is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="cytoplan-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that join_with_hot_keys broadcasts at most, and the rows that make a key one of them.
HOT_KEYS, HOT_ROWS = 1000, 1000


def join_with_hot_keys(rows: DataFrame, names: DataFrame, keys: list[str], count: str, most: int | None = None) -> DataFrame:
    """Inner join of rows with names (distinct keys, and how many rows have them) in which no hot key is dealt to one task.

    The HOT_KEYS keys of most rows, of more than `most` (HOT_ROWS), are joined by a broadcast, the others by their keys. Names may be a
    grouped table that is not written: it is grouped once for the hot keys and once for the join.
    """
    hot = names.where(F.col(count) > (HOT_ROWS if most is None else most)).orderBy(F.desc(count), *keys).limit(HOT_KEYS).collect()
    if not hot:
        return rows.join(names, keys)
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot, names.schema))
    others = rows.join(hot.select(*keys), keys, "left_anti").join(names, keys)
    return rows.join(hot, keys).unionByName(others)


def packed(documents: DataFrame) -> DataFrame:
    """doc_id, text and row: all columns as one, so that their names clash with nothing."""
    every = F.struct(*(documents[c].alias(f"c{i}") for i, c in enumerate(documents.columns)))
    return documents.select("doc_id", "text", every.alias("row"))


def unpacked(columns: list[str], **changed: Column) -> list[Column]:
    """The columns that packed() has put into row, some of them changed."""
    return [changed[c].alias(c) if c in changed else F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)]


def with_copy_numbers(documents: DataFrame, *carry: str) -> DataFrame:
    """doc_id, copy, text and the columns to carry; copy tells rows of one doc_id apart."""
    own = documents.select("doc_id", "text", *carry)
    twice = own.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return own.withColumn("copy", F.lit(0))
    order = Window.partitionBy("doc_id").orderBy("text")
    return own.withColumn("copy", F.row_number().over(order) - 1)
