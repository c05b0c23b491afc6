"""Ranks of all rows without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges that the distinct values are dealt to; their bounds and counts are all that the driver sees.
RANGES = 200


def bounds_of(df: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """At most `ranges` ascending values that cut the column into ranges of about as many rows; all of its values if it has fewer."""
    got = df.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges + 1)], 20 * ranges)).first()[0]
    return sorted(set(got or []))


def range_of(column: str, bounds: list[float]):
    """How many of the bounds lie below a value."""
    return F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b < F.col(column))) if bounds else F.lit(0)


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, n, below): each distinct value that is no null, its rows, and the rows of smaller values.

    Equal values are combined first, so a frequent one is no hot key; distinct values are dealt to ranges, counted there, and each range begins
    where the ones before it end.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.withColumn("range", range_of("value", bounds_of(counted, "value")))
    sizes = dict(dealt.groupBy("range").agg(F.sum("n")).collect())  # RANGES rows at most
    before, total = {}, 0
    for r in sorted(sizes):
        before[r], total = total, total + sizes[r]
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("range")) if before else F.lit(0)
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.select("value", "n", (inside + offset).cast("long").alias("below"))


def running_sum(df: DataFrame, order: str, ties: list[str], value: str, to: str) -> DataFrame:
    """df with the sum of a value over all rows up to each, by an order; equal orders go by `ties`."""
    dealt = df.withColumn("range__", range_of(order, bounds_of(df, order)))
    sums = {r.range__: r.s for r in dealt.groupBy("range__").agg(F.sum(value).alias("s")).collect()}  # RANGES rows at most
    before, total = {}, 0.0
    for r in sorted(sums):
        before[r], total = total, total + sums[r]
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("range__")) if before else F.lit(0.0)
    inside = F.sum(value).over(Window.partitionBy("range__").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn(to, inside + offset).drop("range__")
