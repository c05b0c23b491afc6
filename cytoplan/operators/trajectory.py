"""Cluster-pair tables of a time-aware trajectory. edges: a, b; cells: id, cluster, time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def typical_step(cells: DataFrame) -> DataFrame:
    """Median gap of the sorted distinct times, 1 without one."""
    times = cells.select("time").where("time is not null").distinct()
    gap = F.col("time") - F.lag("time").over(Window.orderBy("time"))  # a row for each time point
    return times.select(gap.cast("double").alias("gap")).where("gap > 0").agg(F.coalesce(F.median("gap"), F.lit(1.0)).alias("step"))


def _pairs(cells: DataFrame) -> DataFrame:
    levels = cells.select("cluster").distinct()
    return levels.toDF("from_cluster").join(levels.toDF("to_cluster"), F.col("from_cluster") < F.col("to_cluster"))


def topology_weights(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Observed cross edges against those expected from the clusters' degrees, for every pair."""
    of = cells.select("id", "cluster")
    named = edges.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b")
    both = named.where("ca != cb").groupBy(F.least("ca", "cb").alias("from_cluster"), F.greatest("ca", "cb").alias("to_cluster")).agg(F.count(F.lit(1)).alias("observed"))
    degree = named.select(F.explode(F.array("ca", "cb")).alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("degree"))
    total = degree.agg(F.sum("degree").alias("total"))
    full = _pairs(cells).join(both, ["from_cluster", "to_cluster"], "left").na.fill(0, ["observed"])
    full = full.join(degree.toDF("from_cluster", "da"), "from_cluster", "left").join(degree.toDF("to_cluster", "db"), "to_cluster", "left").na.fill(0.0, ["da", "db"]).crossJoin(total)
    expected = F.col("da") * F.col("db") / F.greatest("total", F.lit(1.0))
    return full.select("from_cluster", "to_cluster", "observed", expected.alias("expected"), (F.col("observed") / (expected + 1e-8)).alias("weight"))


def time_deltas(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Time differences of cross-cluster edges, from the lower cluster to the higher."""
    of = cells.select("id", "cluster", "time")
    named = edges.join(of.toDF("a", "ca", "ta"), "a").join(of.toDF("b", "cb", "tb"), "b").where("ca != cb and ta is not null and tb is not null")
    swap = F.col("ca") > F.col("cb")
    return named.select(F.least("ca", "cb").alias("from_cluster"), F.greatest("ca", "cb").alias("to_cluster"), F.when(swap, F.col("ta") - F.col("tb")).otherwise(F.col("tb") - F.col("ta")).cast("double").alias("delta"))


def time_overlap(cells: DataFrame) -> DataFrame:
    """Sum over times of the smaller share of each pair of clusters; 1 if one side has no times."""
    n = cells.where("time is not null").groupBy("cluster", "time").agg(F.count(F.lit(1)).alias("n"))
    share = n.select("cluster", "time", (F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))).alias("p"))
    both = share.toDF("from_cluster", "time", "p").join(share.toDF("to_cluster", "time", "q"), "time").where("from_cluster < to_cluster")
    some = share.select("cluster").distinct().withColumn("has", F.lit(1))
    common = both.groupBy("from_cluster", "to_cluster").agg(F.sum(F.least("p", "q")).alias("overlap"))
    full = _pairs(cells).join(common, ["from_cluster", "to_cluster"], "left").join(some.toDF("from_cluster", "h1"), "from_cluster", "left").join(some.toDF("to_cluster", "h2"), "to_cluster", "left")
    return full.select("from_cluster", "to_cluster", F.when(F.col("h1").isNull() | F.col("h2").isNull(), F.lit(1.0)).otherwise(F.coalesce("overlap", F.lit(0.0))).alias("overlap"))


def local_order(edges: DataFrame, values: DataFrame) -> DataFrame:
    """How edges between different times are ordered by pseudotime. values: id, time, pt."""
    v = values.where("time is not null and pt is not null")
    e = edges.join(v.toDF("a", "t1", "p1"), "a").join(v.toDF("b", "t2", "p2"), "b").where("t1 != t2")
    s = F.signum((F.col("t2") - F.col("t1")).cast("double")) * F.signum(F.col("p2") - F.col("p1"))
    inverted = F.avg((s < 0).cast("double"))
    return e.agg(F.count(F.lit(1)).alias("n_edges"), F.avg((s > 0).cast("double")).alias("concordance"), inverted.alias("inversion"), (1 - inverted).alias("direction_score"), F.avg((s == 0).cast("double")).alias("tie_rate"))


def anticausal_mass(edges: DataFrame, medians: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Weight of directed edges whose median time falls. edges: from_cluster, to_cluster, weight; medians: cluster, median."""
    e = edges.join(medians.toDF("from_cluster", "m1"), "from_cluster").join(medians.toDF("to_cluster", "m2"), "to_cluster")
    d, w = F.col("m2") - F.col("m1"), F.coalesce("weight", F.lit(1.0))
    mass = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    total = F.sum(w)
    return e.agg(
        mass(d < -tolerance).alias("anticausal"), mass(F.abs(d) <= tolerance).alias("neutral"), mass(d > tolerance).alias("forward"),
        (mass(d < -tolerance) / total).alias("fraction"), (1 - mass(d < -tolerance) / total).alias("score"),
    )


def time_weights(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """How consistently each pair of clusters is ordered in time; pairs without an edge between timed cells are neutral."""
    flows = time_deltas(edges, cells).groupBy("from_cluster", "to_cluster").agg(
        F.count(F.lit(1)).alias("n_time_edges"), F.avg(F.signum("delta")).alias("flow"), F.median("delta").alias("median_delta")
    )
    middle = cells.where("time is not null").groupBy("cluster").agg(F.median("time").alias("m"))
    pairs = time_overlap(cells).join(middle.toDF("from_cluster", "m1"), "from_cluster", "left").join(middle.toDF("to_cluster", "m2"), "to_cluster", "left")
    both = pairs.join(flows, ["from_cluster", "to_cluster"], "left").crossJoin(F.broadcast(typical_step(cells)))  # one row
    gap = F.col("m2") - F.col("m1")
    steps = F.abs(gap) / F.greatest("step", F.lit(1e-8))
    has = F.col("n_time_edges").isNotNull()
    strength = F.greatest(F.abs("flow"), F.least(F.lit(1.0), steps / 2))
    jump = F.when(has, 1 / (1 + F.greatest(steps - 2, F.lit(0.0)) / 2)).otherwise(1.0)
    consistency = F.when(has, F.least(F.lit(1.0), (0.60 * strength + 0.25 * F.tanh(steps) + 0.15 * (1 - F.col("overlap"))) * F.col("jump"))).otherwise(0.0)
    signed = F.when(has, F.signum(F.when(F.abs("flow") > 1e-8, F.col("flow")).otherwise(gap)) * F.col("consistency")).otherwise(0.0)
    return (
        both.withColumn("gap", gap).withColumn("jump", jump).withColumn("consistency", consistency).withColumn("signed", signed)
        .select(
            "from_cluster", "to_cluster", F.coalesce("n_time_edges", F.lit(0)).alias("n_time_edges"), F.coalesce("flow", F.lit(0.0)).alias("flow"),
            F.coalesce("median_delta", "gap").alias("median_delta"), "gap", "overlap", "jump", "consistency", "signed", ((F.col("signed") + 1) / 2).alias("time_weight"),
        )
    )


def neutral_times(cells: DataFrame) -> DataFrame:
    """The table of time_weights where only topology counts."""
    one, none = F.lit(1.0), F.lit(0.0)
    return _pairs(cells).select(
        "from_cluster", "to_cluster", F.lit(0).cast("long").alias("n_time_edges"), none.alias("flow"), none.alias("median_delta"), none.alias("gap"),
        one.alias("overlap"), one.alias("jump"), one.alias("consistency"), none.alias("signed"), F.lit(0.5).alias("time_weight"),
    )


def cluster_edges(
    topology: DataFrame, times: DataFrame, alpha: float = 1.0, beta: float = 1.0, threshold: float = 0.1, prune: float = 0.01, by: str = "time_weight"
) -> DataFrame:
    """Directed edges of the cluster graph; a pair without a clear direction has one each way. by: time_weight or consistency."""
    t = topology.select("from_cluster", "to_cluster", "observed", F.col("weight").alias("topology_weight"))
    full = t.join(times.select("from_cluster", "to_cluster", "time_weight", "consistency", "signed"), ["from_cluster", "to_cluster"], "left")
    full = full.na.fill({"time_weight": 0.5, "consistency": 0.0, "signed": 0.0})
    weight = F.pow(F.greatest("topology_weight", F.lit(0.0)), F.lit(alpha)) * F.pow(F.col(by), F.lit(beta))
    kept = full.withColumn("weight", weight).where((F.col("observed") > 0) & (F.col("weight") >= prune))
    on, back = F.struct(F.col("from_cluster").alias("s"), F.col("to_cluster").alias("t")), F.struct(F.col("to_cluster").alias("s"), F.col("from_cluster").alias("t"))
    ways = F.when(F.col("signed") > threshold, F.array(on)).when(F.col("signed") < -threshold, F.array(back)).otherwise(F.array(on, back))
    rows = kept.withColumn("ambiguous", F.abs("signed") <= threshold).withColumn("way", F.explode(ways))
    return rows.select(F.col("way.s").alias("from_cluster"), F.col("way.t").alias("to_cluster"), "weight", "topology_weight", "time_weight", "consistency", "signed", "ambiguous")


def cell_pseudotime(cells: DataFrame, cluster_pt: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Each cell's cluster pseudotime plus a share of the smallest step by its rank in time. cluster_pt: cluster, pt.

    Ranks are counted from the sizes of (cluster, time) groups, so no task holds a cluster's cells.
    A cell without a time has no pseudotime where its cluster's cells have several times.
    """
    gaps = cluster_pt.where("pt is not null").select("pt").distinct().select((F.col("pt") - F.lag("pt").over(Window.orderBy("pt"))).alias("g"))  # a row for each cluster
    step = gaps.where("g > 0").agg(F.coalesce(F.min("g"), F.lit(1.0)).alias("step"))
    sizes = cells.groupBy("cluster", "time").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("cluster")
    before = F.sum("n").over(whole.orderBy(F.col("time").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    total = F.sum("n").over(whole)
    ranks = sizes.select(
        "cluster", "time",
        F.when(F.count("time").over(whole) <= 1, 0.0).when(F.col("time").isNotNull(), (before + (F.col("n") - 1) / 2) / (total - 1)).alias("within"),
    )
    named = ranks.withColumnRenamed("cluster", "c").withColumnRenamed("time", "t")
    both = cells.join(F.broadcast(cluster_pt), "cluster", "left").join(named, F.col("cluster").eqNullSafe(F.col("c")) & F.col("time").eqNullSafe(F.col("t")), "left")
    return both.crossJoin(F.broadcast(step)).select("id", "cluster", (F.col("pt") + fraction * F.col("step") * F.col("within")).alias("pseudotime"))


def transitions(edges: DataFrame, clusters: DataFrame, cluster_pt: DataFrame, terminals: list, backward: float = 0.15) -> DataFrame:
    """Probabilities of steps between clusters. edges: from_cluster, to_cluster, weight; clusters: cluster.

    Terminals, and clusters without weight that leads on, absorb; steps back in pseudotime count `backward` of their weight, unless
    the cluster or one it leads to has no entry in cluster_pt.
    """
    known = cluster_pt.select(F.col("cluster"), F.col("pt"), F.lit(True).alias("known"))
    e = edges.join(known.toDF("from_cluster", "p1", "k1"), "from_cluster", "left").join(known.toDF("to_cluster", "p2", "k2"), "to_cluster", "left")
    own = Window.partitionBy("from_cluster")
    all_known = F.min(F.coalesce("k1", F.lit(False)) & F.coalesce("k2", F.lit(False))).over(own)
    back = F.coalesce(F.col("p2") - F.col("p1") < -1e-8, F.lit(False)) & all_known
    w = e.withColumn("w", F.when(back, F.col("weight") * backward).otherwise(F.col("weight")))
    leaving = w.where(~F.col("from_cluster").isin(terminals)).withColumn("s", F.sum("w").over(own)).where("s > 0")
    steps = leaving.groupBy("from_cluster", "to_cluster").agg(F.sum(F.col("w") / F.col("s")).alias("p"))
    stay = clusters.select(F.col("cluster").alias("from_cluster")).join(steps.select("from_cluster").distinct(), "from_cluster", "left_anti")
    return steps.union(stay.select("from_cluster", F.col("from_cluster").alias("to_cluster"), F.lit(1.0).alias("p")))


def branch_table(probabilities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Entropy, commitment and assignment of each cluster. probabilities: cluster, branch, position, p, with all branches of each cluster."""
    own = Window.partitionBy("cluster")
    share = F.col("p") / F.greatest(F.sum("p").over(own), F.lit(1e-12))
    term = F.when(F.col("q") > 0, -F.col("q") * F.log("q")).otherwise(0.0)
    best = F.max_by("branch", F.struct(F.col("p"), -F.col("position")))
    got = probabilities.withColumn("q", share).groupBy("cluster").agg(
        F.sum(term).alias("h"), F.count(F.lit(1)).alias("k"), F.max("p").alias("max_probability"), best.alias("best")
    )
    entropy = F.when(F.col("k") > 1, F.col("h") / F.log("k")).otherwise(0.0)
    return got.withColumn("entropy", entropy).select(
        "cluster", "entropy", (1 - F.col("entropy")).alias("commitment"), "max_probability",
        F.when(F.col("max_probability") < threshold, F.lit("ambiguous")).otherwise(F.col("best").cast("string")).alias("assignment"),
    )


def branch_cells(cells: DataFrame, table: DataFrame, probabilities: DataFrame, branch: str, soft: bool = True, minimum: float = 0.25) -> DataFrame:
    """cells with `selected`: by the probability of a branch, or by assignment to it."""
    if soft:
        of = probabilities.where(F.col("branch").cast("string") == branch).select("cluster", (F.col("p") >= minimum).alias("selected"))
    else:
        of = table.select("cluster", (F.col("assignment") == branch).alias("selected"))
    return cells.join(F.broadcast(of), "cluster", "left").na.fill(False, ["selected"])  # a row for each cluster
