"""The tables that plots are drawn from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.functions.smoothing import smoothing_spline
from cytoplan.operators.metrics import category_scores, rank_methods, tradeoff
from cytoplan.operators.pseudobulk import quantiles_by
from cytoplan.operators.trends import trend_rows

#: The least positive double: adjusted p values of 0 are drawn there.
LEAST = 2.2250738585072014e-308
#: Clusters of a graph whose routes are drawn.
MAX_NODES = 100_000


def reduction_data(cells: DataFrame, reduction: DataFrame, *columns: str, shuffle_seed: int | None = None) -> DataFrame:
    """(cell_id, x, y, columns): the first two dimensions, in a fixed shuffled order if a seed is given. cells: cell_id, ...; reduction: cell_id, embedding."""
    out = reduction.select("cell_id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y")).join(cells.select("cell_id", *columns), "cell_id")
    return out if shuffle_seed is None else out.withColumn("draw_order", F.xxhash64("cell_id", F.lit(shuffle_seed)))


def benchmark_panels(scores: DataFrame) -> dict[str, DataFrame]:
    categories = category_scores(scores)
    return {"ranking": rank_methods(scores), "metrics": scores.select("method", "metric", "score"), "categories": categories, "tradeoff": tradeoff(categories), "heatmap": scores.select("method", "metric", "score")}


def volcano_data(table: DataFrame, fdr_cutoff: float = 0.05, lfc_cutoff: float = 1.0, labels: int = 10) -> DataFrame:
    """table (gene_id, contrast, logfc, fdr, ...) with neg_log10_fdr, de_class and labelled: the first of each contrast by fdr, then by size of logfc."""
    up, down = F.col("logfc") >= lfc_cutoff, F.col("logfc") <= -lfc_cutoff
    hit = F.col("fdr") <= fdr_cutoff
    order = Window.partitionBy("contrast").orderBy("fdr", F.desc(F.abs("logfc")), "gene_id")
    return table.withColumn("neg_log10_fdr", -F.log10(F.greatest("fdr", F.lit(LEAST)))).withColumn("de_class", F.when(hit & up, "Up").when(hit & down, "Down").otherwise("NotSig")).withColumn("labelled", F.row_number().over(order) <= labels)


def ma_data(table: DataFrame, fdr_cutoff: float = 0.05) -> DataFrame:
    return table.select("gene_id", "contrast", "logcpm", "logfc", (F.col("fdr") <= fdr_cutoff).alias("significant"))


def top_genes(table: DataFrame, n: int = 6) -> DataFrame:
    """(gene_id, fdr): the n genes of least adjusted p in any contrast or condition."""
    return table.groupBy("gene_id").agg(F.min("fdr").alias("fdr")).orderBy("fdr", "gene_id").limit(n)


def curve_data(table: DataFrame, curves: DataFrame, n: int = 6) -> DataFrame:
    return curves.join(top_genes(table, n).select("gene_id"), "gene_id", "left_semi")


def cluster_nodes(cells: DataFrame) -> DataFrame:
    """(cluster, size, x, y, plot_size): clusters at the medians of their cells' first two dimensions. cells: cluster, v."""
    at = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.median(F.get("v", F.lit(0))).alias("x"), F.median(F.get("v", F.lit(1))).alias("y"))
    ends = at.agg(F.min("size").alias("low"), F.max("size").alias("high"))
    size = F.when(F.col("high") > F.col("low"), 4 + 6 * (F.col("size") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(7.0)
    return at.crossJoin(F.broadcast(ends)).select("cluster", "size", "x", "y", size.alias("plot_size"))  # one row


def cluster_links(edges: DataFrame, nodes: DataFrame, scale: float = 3.0) -> DataFrame:
    """edges with their ends' places and plot_width."""
    top = edges.agg(F.max("weight").alias("top"))
    start, end = nodes.select(F.col("cluster").alias("from_cluster"), "x", "y"), nodes.select(F.col("cluster").alias("to_cluster"), F.col("x").alias("xend"), F.col("y").alias("yend"))
    width = F.when(F.col("top") > 0, 0.5 + scale * F.col("weight") / F.col("top")).otherwise(0.5)
    return edges.join(start, "from_cluster").join(end, "to_cluster").crossJoin(F.broadcast(top)).withColumn("plot_width", width).drop("top")  # one row


def route_curves(nodes: DataFrame, routes: dict[str, list], points: int = 100) -> DataFrame:
    """(route, step, x, y): ways through the clusters' places, smooth for four clusters or more. A few routes of clusters."""
    rows = nodes.limit(MAX_NODES + 1).collect()  # a row for each cluster
    if len(rows) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} clusters")
    place = {r.cluster: (r.x, r.y) for r in rows}
    parts = []
    for name, way in routes.items():
        at = np.array([place[c] for c in way if c in place], float)
        if len(at) < 2:
            continue
        if len(at) >= 4:
            t = np.arange(len(at), dtype=float)
            at = np.stack([smoothing_spline(t, at[:, k], at=np.linspace(0, t[-1], points), spar=0.5) for k in (0, 1)], 1)
        parts.append(pd.DataFrame({"route": name, "step": np.arange(len(at)), "x": at[:, 0], "y": at[:, 1]}))
    spark = nodes.sparkSession
    return spark.createDataFrame(pd.concat(parts), "route string, step long, x double, y double") if parts else spark.createDataFrame([], "route string, step long, x double, y double")


def causality_data(topology: DataFrame, times: DataFrame, threshold: float = 0.1, prune: float = 0.01, alpha: float = 1.0, beta: float = 1.0, by: str = "time_weight", kept_only: bool = False) -> DataFrame:
    """(from_cluster, to_cluster, topology_weight, signed, weight, edge_status, direction_group) of every pair of clusters."""
    full = topology.select("from_cluster", "to_cluster", "observed", F.col("weight").alias("topology_weight")).join(times.select("from_cluster", "to_cluster", "time_weight", "consistency", "signed"), ["from_cluster", "to_cluster"], "left")
    full = full.na.fill({"time_weight": 0.5, "consistency": 0.0, "signed": 0.0})
    weight = F.pow(F.greatest("topology_weight", F.lit(0.0)), F.lit(alpha)) * F.pow(F.col(by), F.lit(beta))
    kept = (F.col("observed") > 0) & (F.col("weight") >= prune)
    group = F.when(F.abs("signed") <= threshold, "ambiguous").when(F.col("signed") >= 0, "forward").otherwise("backward")
    rows = full.withColumn("weight", weight).select("from_cluster", "to_cluster", "topology_weight", "signed", "weight", F.when(kept, "kept").otherwise("pruned").alias("edge_status"), group.alias("direction_group"))
    return rows.where("edge_status = 'kept'") if kept_only else rows


def calibration_data(cells: DataFrame, summary: bool = True) -> DataFrame:
    """Pseudotimes by time: their quartiles, or the rows. cells: time, pt."""
    known = cells.where("time is not null and pt is not null").select("time", "pt")
    return quantiles_by(known, ["time"], "pt") if summary else known


def branch_bars(branch_cells: DataFrame, probabilities: DataFrame, n: int = 20) -> DataFrame:
    """(id, branch, p) of the n cells of highest entropy. branch_cells: id, cluster, entropy."""
    top = branch_cells.where("entropy is not null").orderBy(F.desc("entropy"), "id").limit(n)
    return top.select("id", "cluster").join(probabilities.select("cluster", "branch", "p"), "cluster").select("id", "branch", "p")


def branch_points(places: DataFrame, cells: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(id, x, y, branch, p): every cell once for each branch. places: id, x, y; cells: id, cluster."""
    return places.join(cells.select("id", "cluster"), "id").join(probabilities.select("cluster", "branch", "p"), "cluster").select("id", "x", "y", "branch", "p")


def heatmap_data(trends: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """trends with z and row_order: genes by cluster, if given, then by the pseudotime of their highest value, then by name."""
    rows = trend_rows(trends)
    peak = rows.groupBy("gene_id").agg(F.max_by("pseudotime", F.struct("z", -F.col("pseudotime"))).alias("peak"))
    named = peak.join(clusters, "gene_id", "left") if clusters is not None else peak.withColumn("trend_cluster", F.lit(1))
    order = named.withColumn("row_order", F.row_number().over(Window.orderBy("trend_cluster", "peak", "gene_id")))  # a row for each gene
    return rows.join(order.select("gene_id", "trend_cluster", "row_order"), "gene_id")


def overview(nodes: DataFrame, edges: DataFrame, cells: DataFrame, topology: DataFrame, times: DataFrame, probabilities: DataFrame) -> dict[str, DataFrame]:
    """The tables of the overview of a trajectory. cells: id, cluster, time, pt, entropy."""
    return {"graph": cluster_links(edges, nodes), "causality": causality_data(topology, times), "calibration": calibration_data(cells), "bars": branch_bars(cells, probabilities), "pseudotime": cells.select("id", "pt"), "entropy": cells.select("id", "entropy")}
