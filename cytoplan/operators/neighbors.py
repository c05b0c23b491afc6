"""Exact nearest neighbours and the graphs made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.functions.settle import forget, settled
from cytoplan.operators import blockwise
from cytoplan.operators.blockwise import BLOCK


def block_pairs(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """left, right: the rows of every two blocks of points, a row for each two blocks. points: id, v and other columns."""
    blocks = max(1, -(-points.count() // block))
    row = F.struct("id", F.col("v").cast("array<double>").alias("v"), *(c for c in points.columns if c not in ("id", "v")))
    packed = points.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).agg(F.collect_list(row).alias("rows"))
    left, right = packed.toDF("b1", "left"), packed.toDF("b2", "right")
    return left.crossJoin(right).repartition(max(1, min(blocks * blocks, 2000)), "b1", "b2").select("left", "right")


def knn(points: DataFrame, k: int = 15, block: int = BLOCK) -> DataFrame:
    """(i, j, rank, distance) of the k nearest others of every point, a written table. points: id (long), v (array of numbers).

    All pairs are compared, see blockwise: a task holds its own block and a chunk of all points at a time, so that what is written
    grows with the points. Distances are rounded to 9 digits, ties go by id.
    """
    rows = blockwise.packed(points, block)
    found = blockwise.nearest(rows, rows, k, own=True)
    forget(rows)
    return found


def adjacency(neighbours: DataFrame) -> DataFrame:
    """Undirected edges (a < b)."""
    return neighbours.where("i != j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def weighted_graph(neighbours: DataFrame) -> DataFrame:
    """Undirected edges with the mean of 1 / (1 + distance)."""
    w = neighbours.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (1 / (1 + F.col("distance"))).alias("weight"))
    return w.groupBy("a", "b").agg(F.avg("weight").alias("weight"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id that can be reached, by alternating star contraction (Kiveris et al. 2014).

    Each round links every vertex's larger neighbours, then its smaller ones, to the smallest known one, until every component is a star.
    """
    now = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    for _ in range(max_rounds):
        large = settled(_large_star(now))
        last, now = now, settled(_small_star(large))
        forget(large, last)
        # A star: no vertex has two smaller neighbours, or a smaller and a larger one.
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 0 AND down + up > 1").isEmpty():
            return vertices.select("id").join(now.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def mutual_pairs(points: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(i, j) of two batches that are among each other's nearest. first: neighbours i -> j, second: j -> i."""
    return first.select("i", "j").join(second.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"])


def knn_between(points: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(i, j, distance): the k nearest of `points` for every one of `queries`; ties by id. A written table, see knn."""
    looking, stored = blockwise.packed(queries, block), blockwise.packed(points, block)
    found = blockwise.nearest(looking, stored, k, own=False)
    forget(looking, stored)
    return found.select("i", "j", "distance")


def cosine_normalised(points: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Vectors over their length, at least `floor`."""
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return points.withColumn("size__", F.greatest(size, F.lit(floor))).withColumn("v", F.transform("v", lambda x: x / F.col("size__"))).drop("size__")


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row with `modularity`. edges: a, b, weight; communities: id, community."""
    named = edges.join(communities.toDF("a", "x"), "a").join(communities.toDF("b", "y"), "b")
    ends = named.select(F.col("x").alias("c"), "weight").union(named.select("y", "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    facts = named.agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)).alias("s"), F.sum("weight").alias("m")).crossJoin(ends.agg(F.sum(F.col("d") * F.col("d")).alias("q")))
    return facts.select((F.col("s") / F.col("m") - resolution * F.col("q") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
