"""Sparse count matrices in Matrix Market files with their tables of barcodes and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The names that the format's files and folders have.
FOLDERS = ("", "filtered_feature_bc_matrix", "raw_feature_bc_matrix", "outs/filtered_feature_bc_matrix", "outs/raw_feature_bc_matrix")
FILES = {
    "matrix": ("matrix.mtx", "matrix.mtx.gz"),
    "barcodes": ("barcodes.tsv", "barcodes.tsv.gz"),
    "features": ("features.tsv", "features.tsv.gz", "genes.tsv", "genes.tsv.gz"),
}


def locate(spark: SparkSession, path: str) -> dict[str, str]:
    """The matrix, barcodes and features files below path, on any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in FOLDERS:
        root = f"{path.rstrip('/')}/{folder}".rstrip("/")
        found = {kind: next((f"{root}/{n}" for n in names if fs.exists(hadoop(f"{root}/{n}"))), None) for kind, names in FILES.items()}
        if all(found.values()):
            return found
    raise FileNotFoundError(f"no matrix.mtx, barcodes.tsv and features.tsv (or .gz) below {path}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, row): the lines of a file, or of a folder of parts in the order of their names, with their place, from 1.

    Counts of the files' blocks give each block's first place, so lines are numbered without bringing them to one task.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", place.alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    start = blocks.select("block", "first", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # a row for each block
    return lines.join(F.broadcast(start), "block").select("value", (F.col("before") + F.col("at") - F.col("first") + 1).alias("row"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(row, fields): a tab-separated file without header."""
    return numbered_lines(spark, path).select("row", F.split("value", "\t").alias("fields"))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a coordinate matrix; entries of a pattern are 1, repeated places are summed, zeros left out.

    path: a file, or a folder of parts, one of which begins with the head.
    """
    lines = spark.read.text(path)
    kind = lines.select("value", F.col("_metadata.file_path").alias("file")).where(F.col("value").startswith("%%MatrixMarket")).limit(1).first()
    words = kind["value"].lower().split() if kind else []
    if words[1:3] != ["matrix", "coordinate"] or words[4:5] != ["general"]:
        raise ValueError(f"{path} is not a general coordinate matrix: {' '.join(words)}")
    # The size is the first line of the head's file that is no comment.
    place = F.struct((F.col("_metadata.file_path") != kind["file"]).alias("other"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = lines.select("value", place.alias("place")).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    body = rows.crossJoin(F.broadcast(rows.agg(F.min("place").alias("head")))).where(F.col("place") != F.col("head"))
    parts = F.split(F.trim("value"), r"\s+")
    entry = body.select(parts[0].cast("long").alias("row"), parts[1].cast("long").alias("col"), (F.lit(1.0) if words[3] == "pattern" else parts[2].cast("double")).alias("value"))
    return entry.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value != 0")
