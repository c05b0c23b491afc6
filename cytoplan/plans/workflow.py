"""Workflows over an experiment: preprocessing, and differential expression from cells to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplan.functions.settle import settled
from cytoplan.operators import expression, features, integration, pseudobulk, qc, reduction
from cytoplan.sources import experiment
from cytoplan.sources.experiment import Experiment


def from_parts(spark: SparkSession, path: str) -> Experiment:
    """An experiment from the Parquet tables that Experiment.write makes, or that another program has exported: cells, genes, assays/..., reductions/..."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def below(kind: str) -> dict[str, DataFrame]:
        folder = hadoop(f"{path.rstrip('/')}/{kind}")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        return {n: spark.read.parquet(f"{path.rstrip('/')}/{kind}/{n}") for n in names}

    assays = below("assays")
    if not assays:
        raise FileNotFoundError(f"no assays below {path}")
    cells, genes = (spark.read.parquet(f"{path.rstrip('/')}/{kind}") for kind in ("cells", "genes"))
    whole = {}
    for name, table in below("reductions").items():
        if cells.join(table, "cell_id", "left_anti").isEmpty():  # only those that cover every cell
            whole[name] = table
    return Experiment(cells, genes, assays, whole, {"source": path})


def with_pca(exp: Experiment, k: int = 30, feature_set: str = "hvg", n: int = 2000, name: str = "PCA") -> Experiment:
    """exp with log counts and principal components of at least k dimensions; those that it has already are kept."""
    assays = dict(exp.assays)
    if "logcounts" not in assays:
        assays["logcounts"] = settled(features.log_normalise(assays["counts"]).select("cell_id", "gene_id", F.col("logcount").alias("value")))
    if name in exp.reductions and (exp.reductions[name].select(F.min(F.size("embedding"))).first()[0] or 0) >= k:
        return Experiment(exp.cells, exp.genes, assays, exp.reductions, exp.meta)
    logs = assays["logcounts"].select("cell_id", "gene_id", F.col("value").alias("logcount"))
    genes = settled(features.select_features(logs, exp.genes, exp.cells.count(), feature_set, n))
    scores, _ = reduction.truncated_pca(exp.cells, logs, genes, k)
    return Experiment(exp.cells, exp.genes, assays, exp.reductions | {name: settled(scores)}, exp.meta)


def unintegrated(
    exp: Experiment, k: int = 30, neighbours: int = 20, algorithm: str = "louvain", resolution: float = 0.8, column: str = "unintegrated_cluster", feature_set: str = "hvg", umap: str | None = None,
) -> Experiment:
    """exp with components, clusters of them as a column of the cells, and, if `umap` names it, a layout of them."""
    made = with_pca(exp, k, feature_set)
    named = made.cells.select("cell_id", F.xxhash64("cell_id").alias("id"))
    points = named.join(made.reductions["PCA"], "cell_id").select("id", F.col("embedding").alias("v"))
    found = named.join(integration.clusters_of(points, neighbours, algorithm, None if algorithm == "walktrap" else resolution), "id").select("cell_id", F.col("cluster").alias(column))
    entry = {"k": k, "feature_set": feature_set, "neighbours": neighbours, "algorithm": algorithm, "resolution": resolution, "cluster_column": column, "umap": umap}
    out = Experiment(made.cells.join(found, "cell_id", "left"), made.genes, made.assays, made.reductions, made.meta | {"unintegrated": entry})
    return integration.with_layout(out, "PCA", umap) if umap else out


def created(spark: SparkSession, x, run_unintegrated: bool = False, min_counts: float | None = None, min_features: int | None = None, unintegrated_options: dict | None = None, **options) -> Experiment:
    """experiment.create() with preprocessing in one call: cells of enough counts and features, then, if asked for, the unintegrated workflow."""
    exp = experiment.create(spark, x, **options)
    if min_counts is not None or min_features is not None:
        found = qc.qc_metrics(exp.cells.select("cell_id"), exp.assays["counts"])
        kept = settled(qc.filter_cells(found, min_counts or 0, min_features or 0).select("cell_id"))
        only = lambda t: t.join(kept, "cell_id", "left_semi")
        exp = Experiment(only(exp.cells), exp.genes, {n: only(t) for n, t in exp.assays.items()}, {n: only(t) for n, t in exp.reductions.items()}, exp.meta | {"filter": {"min_counts": min_counts, "min_features": min_features}})
    return unintegrated(exp, **(unintegrated_options or {})) if run_unintegrated else exp


def differential(cells: DataFrame, counts: DataFrame, sample_columns: list[str], mode: str = "pairwise", min_cells: int = 10, **options) -> dict[str, DataFrame]:
    """Cells to samples to tables: mode pairwise (table) or time_series (table, curves). options are those of pairwise_de and spline_de."""
    if mode not in ("pairwise", "time_series"):
        raise ValueError(f"unknown mode {mode}")
    samples, values = pseudobulk.pseudobulk(cells, counts, sample_columns, min_cells=min_cells)
    samples, values = settled(samples), settled(values)
    if mode == "pairwise":
        table, _ = expression.pairwise_de(samples, values, **options)
        return {"samples": samples, "table": table}
    table, curves = expression.spline_de(samples, values, **options)
    return {"samples": samples, "table": table, "curves": curves}
