"""Reading labels as numbers and times as an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_number(label) -> F.Column:
    """A label as a number, decimal or hexadecimal; null for any other."""
    text = F.trim(F.col(label).cast("string"))
    hexadecimal = F.conv(F.substring(text, 3, 100), 16, 10).cast("double")
    return F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), hexadecimal).when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def numeric_time(df: DataFrame, column: str, to: str) -> DataFrame:
    """df with times as numbers: those of numbers and dates (seconds) as they are, of labels their number if every row has one, else their rank by name."""
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "date"):
        return df.withColumn(to, F.unix_timestamp(F.col(column).cast("timestamp")).cast("double"))
    if kind != "string":
        return df.withColumn(to, F.col(column).cast("double"))
    all_numbers = df.agg(F.coalesce(F.bool_and(as_number(column).isNotNull()), F.lit(False)).alias("numbers__"))
    rank = df.select(F.col(column).alias("l__")).where("l__ is not null").distinct().withColumn("r__", F.row_number().over(Window.orderBy("l__")).cast("double"))  # a row for each label
    both = df.crossJoin(F.broadcast(all_numbers)).join(rank, F.col(column) == F.col("l__"), "left")
    return both.withColumn(to, F.when(F.col("numbers__"), as_number(column)).otherwise(F.col("r__"))).drop("numbers__", "l__", "r__")
