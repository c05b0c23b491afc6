"""Pseudotime of clusters on their directed graph, terminals and absorption. edges: from_cluster, to_cluster, weight, ambiguous, consistency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.functions.settle import settled

EPS = 1e-8


#: Sources times arcs (or clusters squared) that the driver works on.
DRIVER_CELLS = 4_000_000


def _collected(arcs: DataFrame, starts: DataFrame) -> tuple[list, list] | None:
    """The rows of both, or None if there are too many for the driver."""
    most = int(DRIVER_CELLS**0.5) * 10
    rows = arcs.limit(most + 1).collect()
    sources = starts.select("cluster").distinct().limit(most + 1).collect() if len(rows) <= most else []
    return (rows, [r.cluster for r in sources]) if len(rows) <= most and len(rows) * max(1, len(sources)) <= DRIVER_CELLS else None


def _small_path_lengths(arcs: list, sources: list, longest: bool, max_rounds: int, starts: DataFrame) -> DataFrame:
    names = list(dict.fromkeys([*sources, *(r.s for r in arcs), *(r.t for r in arcs)]))
    place = {c: k for k, c in enumerate(names)}
    s, t, step = (np.array([f(r) for r in arcs]) for f in (lambda r: place[r.s], lambda r: place[r.t], lambda r: float(r.step)))
    none = -np.inf if longest else np.inf
    length = np.full((len(names), len(sources)), none)
    length[[place[c] for c in sources], np.arange(len(sources))] = 0.0
    meet = np.maximum if longest else np.minimum
    for _ in range(max_rounds if arcs else 0):
        before = length.copy()
        meet.at(length, t, before[s] + step[:, None])
        if np.array_equal(before, length):
            break
    else:
        if arcs:
            raise RuntimeError(f"path lengths did not settle in {max_rounds} rounds")
    kind = dict(starts.dtypes)["cluster"]
    rows = [(sources[j], names[i], float(length[i, j])) for i, j in zip(*np.nonzero(np.isfinite(length)), strict=True)]
    return starts.sparkSession.createDataFrame(rows, f"source {kind}, cluster {kind}, length double")


def path_lengths(arcs: DataFrame, starts: DataFrame, longest: bool = False, max_rounds: int = 1000) -> DataFrame:
    """(source, cluster, length) of the shortest paths, or of the longest on a graph without cycles. arcs: s, t, step; starts: cluster.

    Each round adds one arc; it ends when no length changes. A graph of few clusters is settled by the driver; beyond DRIVER_CELLS a round is
    a join.
    """
    best = F.max if longest else F.min
    small = _collected(arcs, starts)
    if small is not None:
        return _small_path_lengths(*small, longest, max_rounds, starts)
    now = settled(starts.select(F.col("cluster").alias("source"), "cluster", F.lit(0.0).alias("length")))
    own = settled(arcs.groupBy("s", "t").agg(best("step").alias("step")))
    for _ in range(max_rounds):
        more = now.join(own, F.col("cluster") == F.col("s")).select("source", F.col("t").alias("cluster"), (F.col("length") + F.col("step")).alias("length"))
        after = settled(now.union(more).groupBy("source", "cluster").agg(best("length").alias("length")))
        moved = after.join(now.withColumnRenamed("length", "old"), ["source", "cluster"], "left").where("old is null or old != length")
        if moved.isEmpty():
            return after
        now = after
    raise RuntimeError(f"path lengths did not settle in {max_rounds} rounds")


def undirected(edges: DataFrame) -> DataFrame:
    """Both ways of every pair, with the sum of its edges' weights as nearness."""
    w = edges.groupBy(F.least("from_cluster", "to_cluster").alias("s"), F.greatest("from_cluster", "to_cluster").alias("t")).agg(F.sum("weight").alias("w"))
    arcs = w.select("s", "t", (1 / F.greatest("w", F.lit(EPS))).alias("step"))
    return arcs.union(arcs.select("t", "s", "step"))


def closeness(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean nearness: reached clusters over the sum of the distances to them; 0 alone."""
    far = path_lengths(undirected(edges), clusters).where("source != cluster").groupBy(F.col("source").alias("cluster")).agg((F.count(F.lit(1)) / F.sum("length")).alias("closeness"))
    return clusters.select("cluster").join(far, "cluster", "left").na.fill(0.0, ["closeness"])


def choose_root(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: of the clusters with cells of the earliest time, the one with the largest share of them, then the closest to all, then the largest. cells: cluster, time."""
    first = cells.agg(F.min("time").alias("first"))
    of = cells.crossJoin(F.broadcast(first)).groupBy("cluster").agg(F.avg(F.coalesce((F.col("time") == F.col("first")).cast("double"), F.lit(0.0))).alias("early"), F.count(F.lit(1)).alias("size"))
    timed = of.agg(F.max("early").alias("any"))
    able = of.crossJoin(F.broadcast(timed)).where("early > 0 or any = 0")
    near = closeness(edges, cells.select("cluster").distinct()).withColumn("closeness", F.round("closeness", 9))
    return able.join(near, "cluster").orderBy(F.desc("early"), F.desc("closeness"), F.desc("size"), "cluster").select("cluster").limit(1)


def cluster_pseudotime(edges: DataFrame, medians: DataFrame, root: DataFrame, step: DataFrame) -> DataFrame:
    """(cluster, pt): the longest way from the root along edges that lead on in time; others by their time and distance. medians: cluster, median.

    An edge adds its time in steps, at least 0.35, more where it is weak, ambiguous or inconsistent. Clusters that no such way
    reaches but that hang together with the root come after it by time and undirected distance.
    """
    known = medians.agg(F.max("median").alias("top"))
    edges = settled(edges)
    base = medians.crossJoin(F.broadcast(root.toDF("root"))).crossJoin(F.broadcast(known)).crossJoin(F.broadcast(step))  # one row each
    order = settled(base.select("cluster", "median", "root", "step", F.struct((F.col("cluster") != F.col("root")).alias("later"), F.coalesce("median", "top").alias("m"), F.col("cluster").alias("c")).alias("place")))
    e = edges.join(order.select(F.col("cluster").alias("from_cluster"), F.col("median").alias("m1"), F.col("place").alias("o1"), "step"), "from_cluster")
    e = e.join(order.select(F.col("cluster").alias("to_cluster"), F.col("median").alias("m2"), F.col("place").alias("o2")), "to_cluster").where("o1 < o2")
    heaviest = edges.agg(F.max("weight").alias("heaviest"))
    units = F.greatest(F.coalesce((F.col("m2") - F.col("m1")) / F.greatest("step", F.lit(EPS)), F.lit(0.0)), F.lit(0.35))
    weak = 1 + 0.35 * (1 - F.col("weight") / F.when(F.col("heaviest") > 0, F.col("heaviest")).otherwise(1.0))
    loose = 1 + 0.25 * (1 - F.least(F.greatest("consistency", F.lit(0.0)), F.lit(1.0)))
    arcs = e.crossJoin(F.broadcast(heaviest)).select(F.col("from_cluster").alias("s"), F.col("to_cluster").alias("t"), (units * weak * loose * F.when(F.col("ambiguous"), 1.35).otherwise(1.0)).alias("step"))
    start = root.toDF("cluster")
    path = path_lengths(arcs, start, longest=True).select("cluster", F.col("length").alias("path"))
    around = path_lengths(undirected(edges), start).select("cluster", F.col("length").alias("around"))
    facts = path.agg(F.max("path").alias("max_path")).crossJoin(around.agg(F.min("around").alias("low"), F.max("around").alias("high")))
    root_median = order.where("cluster = root").select(F.col("median").alias("root_median"))
    full = order.join(path, "cluster", "left").join(around, "cluster", "left").crossJoin(facts).crossJoin(root_median)
    anchor = F.greatest(F.lit(0.0), (F.col("median") - F.col("root_median")) / F.greatest("step", F.lit(EPS)))
    unit = F.when(F.col("high") == F.col("low"), F.col("around") * 0).otherwise((F.col("around") - F.col("low")) / (F.col("high") - F.col("low")))
    pt = F.coalesce("path", F.col("anchor") + 0.75 + unit * (F.col("max_path") + 0.75))
    return full.withColumn("anchor", anchor).withColumn("pt", pt).select("cluster", F.when(F.col("pt").isNotNull(), F.greatest(F.col("pt"), 0.85 * F.col("anchor"))).alias("pt"))


def terminals(edges: DataFrame, cluster_pt: DataFrame, root: DataFrame) -> DataFrame:
    """(cluster) without a clear edge to a later one, the root left out; without any, the last of each component."""
    pts = cluster_pt.select("cluster", "pt")
    rest = pts.join(root.toDF("cluster"), "cluster", "left_anti")
    out = edges.where("not ambiguous").join(pts.toDF("from_cluster", "p1"), "from_cluster").join(pts.toDF("to_cluster", "p2"), "to_cluster")
    state = out.groupBy(F.col("from_cluster").alias("cluster")).agg(F.max((F.col("p2") > F.col("p1") + EPS).cast("int")).alias("later"), F.max(F.coalesce("p1", "p2").isNotNull().cast("int")).alias("known"))
    found = rest.join(state, "cluster", "left").where("known is null or (known = 1 and coalesce(later, 0) = 0)").select("cluster")
    found = settled(found)
    if not found.isEmpty():
        return found
    from cytoplan.operators.neighbors import components

    parts = components(pts.select(F.col("cluster").alias("id")), edges.select(F.col("from_cluster").alias("a"), F.col("to_cluster").alias("b")))
    last = pts.join(parts.toDF("cluster", "part"), "cluster").where("pt is not null").groupBy("part").agg(F.min(F.struct((-F.col("pt")).alias("back"), "cluster")).alias("last"))
    return last.select("last.cluster")


def absorption(transitions: DataFrame, ends: DataFrame, rounds: int = 60) -> DataFrame:
    """(cluster, terminal, p): chance to be absorbed by each terminal, by squaring the step probabilities until they rest.

    transitions: from_cluster, to_cluster, p. Rows are brought to sum 1 over the terminals, or 0 where none is reached. A graph of few
    clusters is settled by the driver; beyond DRIVER_CELLS a squaring is a join.
    """
    clusters = transitions.select(F.col("from_cluster").alias("cluster")).distinct()
    count = clusters.count()
    now = _small_powers(transitions, rounds) if count * count <= DRIVER_CELLS else _large_powers(transitions, rounds)
    # Of what has reached a terminal by then, the shares.
    grid = clusters.crossJoin(F.broadcast(ends.select(F.col("cluster").alias("terminal"))))  # a row for each terminal
    full = grid.join(now.toDF("cluster", "terminal", "p"), ["cluster", "terminal"], "left").na.fill(0.0, ["p"])
    total = full.groupBy("cluster").agg(F.greatest(F.sum("p"), F.lit(1e-12)).alias("total"))
    return full.join(total, "cluster").select("cluster", "terminal", (F.col("p") / F.col("total")).alias("p"))


def _small_powers(transitions: DataFrame, rounds: int) -> DataFrame:
    rows = transitions.collect()
    names = list(dict.fromkeys([*(r.from_cluster for r in rows), *(r.to_cluster for r in rows)]))
    place = {c: k for k, c in enumerate(names)}
    p = np.zeros((len(names), len(names)))
    for r in rows:
        p[place[r.from_cluster], place[r.to_cluster]] += r.p
    for _ in range(rounds):
        after = p @ p
        moved, p = bool((np.abs(after - p) > 1e-12).any()), after
        if not moved:
            break
    else:
        if len(names):
            raise RuntimeError(f"absorption did not settle in {rounds} squarings")
    kind = dict(transitions.dtypes)["from_cluster"]
    found = [(names[i], names[j], float(p[i, j])) for i, j in zip(*np.nonzero(p > 0), strict=True)]
    return transitions.sparkSession.createDataFrame(found, f"from_cluster {kind}, to_cluster {kind}, p double")


def _large_powers(transitions: DataFrame, rounds: int) -> DataFrame:
    now = settled(transitions.groupBy("from_cluster", "to_cluster").agg(F.sum("p").alias("p")))
    for _ in range(rounds):
        further = now.toDF("from_cluster", "m", "p").join(now.toDF("m", "to_cluster", "q"), "m").groupBy("from_cluster", "to_cluster").agg(F.sum(F.col("p") * F.col("q")).alias("p")).where("p > 1e-15")
        after = settled(further)
        moved = after.join(now.withColumnRenamed("p", "old"), ["from_cluster", "to_cluster"], "full").where("abs(coalesce(p, 0) - coalesce(old, 0)) > 1e-12")
        now = after
        if moved.isEmpty():
            return now
    raise RuntimeError(f"absorption did not settle in {rounds} squarings")
