"""Reading the supplied tables, and their views as cells, genes and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells: batch is the region, condition the market segment."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("batch"))
    c = read(spark, sf_dir, "customer")
    return c.join(place, c.c_nationkey == place.n_nationkey).select(F.col("c_custkey").alias("cell_id"), "batch", F.col("c_mktsegment").alias("condition"), F.col("c_acctbal").alias("balance"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as genes: the quantity of each that each customer ordered."""
    line, orders, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    of = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    return of.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_name").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as cells: id, v, cluster (the label), batch, time."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("cluster"),
        (F.col("vec_id") % 3).alias("batch"), (F.col("label") % 5).cast("long").alias("time"),
    )
