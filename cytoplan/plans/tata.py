"""The time-aware trajectory of cells from end to end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.functions.settle import settled
from cytoplan.operators import branching, features, integration, nearindex, neighbors, pseudotime, trajectory, trends


@dataclass
class Trajectory:
    """cells: id, cluster, time, pseudotime, pt (0 to 1), entropy, commitment, max_probability, assignment; what was not asked for is None."""

    cells: DataFrame
    edges: DataFrame
    clusters: DataFrame
    neighbours: DataFrame
    root: object = None
    terminals: list = field(default_factory=list)
    transitions: DataFrame | None = None
    probabilities: DataFrame | None = None
    branches: DataFrame | None = None
    space: DataFrame | None = None
    parameters: dict = field(default_factory=dict)


def run(
    points: DataFrame, use_time: bool = True, clusters: str | None = None, k: int = 15, algorithm: str = "louvain", resolution: float = 1.0, alpha: float = 1.0, beta: float = 1.0,
    direction_threshold: float = 0.1, prune_threshold: float = 0.01, time_weight_mode: str = "time_weight", refine: bool = False, min_refine_size: int = 60,
    do_pseudotime: bool = True, root=None, do_branches: bool = True, expected_branches: int | None = None, components: int = 5,
) -> Trajectory:
    """points: id, v, and time and a column of given clusters where these are used. Without given clusters, communities of the neighbour graph serve.

    time_weight_mode: time_weight or consistency. Stages that are not asked for are not run.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    if time_weight_mode not in ("time_weight", "consistency"):
        raise ValueError(f"unknown mode {time_weight_mode}")
    if use_time and "time" not in points.columns:
        raise ValueError("the points have no time")
    if do_branches and not do_pseudotime:
        raise ValueError("branches need a pseudotime")
    timed = points.select("id", "v", (F.col("time") if use_time else F.lit(None)).cast("double").alias("time"), *([F.col(clusters).cast("string").alias("cluster")] if clusters else []))
    nn = settled(nearindex.nearest(timed.select("id", "v"), int(k)))
    edges = settled(neighbors.adjacency(nn))
    if not clusters:
        found = integration.found_communities(timed.select("id"), neighbors.weighted_graph(nn), algorithm, None if algorithm == "walktrap" else resolution)
        timed = timed.join(found.select("id", F.concat(F.lit("C"), F.col("community").cast("string")).alias("cluster")), "id")
    timed = settled(timed)
    if refine and use_time:
        timed = settled(timed.drop("cluster").join(branching.refined_clusters(timed, min_refine_size), "id"))
    topology = trajectory.topology_weights(edges, timed)
    times = trajectory.time_weights(edges, timed) if use_time else trajectory.neutral_times(timed)
    graph = settled(trajectory.cluster_edges(topology, times, alpha, beta, direction_threshold, prune_threshold, time_weight_mode))
    medians = timed.groupBy("cluster").agg(F.median("time").alias("median"), F.count(F.lit(1)).alias("size"))
    parameters = {"k": int(k), "alpha": alpha, "beta": beta, "direction_threshold": direction_threshold, "prune_threshold": prune_threshold, "use_time": use_time, "refine": refine, "expected_branches": expected_branches}
    out = Trajectory(timed.drop("v"), graph, settled(medians), nn, parameters=parameters)
    if not do_pseudotime:
        return out
    if root is None:
        start = settled(pseudotime.choose_root(graph, timed))
    else:
        start = settled(out.clusters.where(F.col("cluster") == str(root)).select("cluster"))
        if start.isEmpty():
            raise ValueError(f"there is no cluster {root}")
    out.root = start.first()["cluster"]
    pt = settled(pseudotime.cluster_pseudotime(graph, out.clusters.select("cluster", "median"), start, trajectory.typical_step(timed)))
    out.clusters = settled(out.clusters.join(pt, "cluster", "left").withColumn("is_root", F.col("cluster") == out.root))
    own = trajectory.cell_pseudotime(timed, pt)
    cells = settled(features.scale_to_unit(timed.join(own.select("id", "pseudotime"), "id"), "pseudotime", "pt"))
    if do_branches:
        rows = pt.limit(branching.MAX_EDGES + 1).collect()  # a row for each cluster
        if len(rows) > branching.MAX_EDGES:
            raise ValueError(f"more than {branching.MAX_EDGES} clusters")
        known = {r.cluster: r.pt for r in rows}
        routes = branching.Routes(graph, out.root)
        ends = sorted(r.cluster for r in pseudotime.terminals(graph, pt, start).collect())
        if expected_branches:
            out.terminals = branching.expected_terminals(routes, sorted(known), ends, known, expected_branches)
        else:
            out.terminals = branching.collapsed_terminals(routes, ends, known) if len(ends) > 1 else ends
        if not out.terminals:
            raise ValueError("no terminal cluster was found")
        steps = trajectory.transitions(graph, out.clusters.select("cluster"), pt, out.terminals)
        out.transitions = settled(steps)
        names = points.sparkSession.createDataFrame([(t, i) for i, t in enumerate(out.terminals)], "terminal string, position int")
        chance = pseudotime.absorption(out.transitions, names.select(F.col("terminal").alias("cluster")))
        out.probabilities = settled(chance.join(F.broadcast(names), "terminal").select("cluster", F.col("terminal").alias("branch"), "position", "p"))
        out.branches = settled(trajectory.branch_table(out.probabilities))
        shares = out.probabilities.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "p"))), lambda x: x["p"]).alias("p"))  # one for each terminal
        cells = settled(cells.join(out.branches, "cluster", "left").join(shares, "cluster", "left"))
    out.cells = cells.drop("v", "p")
    out.space = trends.cell_space(cells.select("id", "v", "pt", *(["p"] if do_branches else [])), components)
    return out
