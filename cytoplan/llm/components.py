"""Connected components of an edge table by alternating star contraction.

After Kiveris et al. (2014): each round links every vertex's larger neighbours, then its smaller ones,
to the smallest known one. Both halves are a grouped minimum and a join, so no neighbour list of a hub
is ever gathered, and the edges of the greatest hubs are joined by a broadcast of bounded size. The rounds end when every component
is a star: further rounds would change nothing. A round writes two tables, as each file of a table costs more than its few rows do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.llm.common import HOT_ROWS, join_with_hot_keys, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = join_with_hot_keys(both.where("v > u"), least, ["u"], "n", HOT_ROWS).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    out = join_with_hot_keys(down, least, ["u"], "n", HOT_ROWS).select("v", "m").where("v != m").toDF("u", "v")
    return out.union(least.select("u", "m").toDF("u", "v")).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether no vertex has two smaller neighbours, or a smaller and a larger one. edges: u > v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    vertices = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not vertices.where("down > 0 AND down + up > 1").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex of an edge that is not the root itself; root is the smallest vertex of its component.

    edges: two columns of one orderable type. Edges from a vertex to itself are left out.
    """
    now = written(edges.toDF("u", "v").where("u != v").distinct(), "edges")
    for _ in range(max_rounds):
        now = written(_small_star(written(_large_star(now), "large")), "stars")
        if _all_stars(now):
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
