"""Normalisation, feature selection and scaling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.functions.ranking import bounds_of

#: Ranges of the mean that genes are dealt to for the trend of their variances.
BINS = 200


def log_normalise(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """log1p of counts per `scale` of the cell's total; zeros stay implicit."""
    size = F.greatest(F.sum("value").over(Window.partitionBy("cell_id")), F.lit(1.0))
    return counts.withColumn("logcount", F.log1p(F.col("value") * scale / size))


def gene_variance(logcounts: DataFrame, n_cells: int) -> DataFrame:
    """Population mean and variance of each gene over all cells, the ones without a row counting as zero."""
    mean = F.sum("logcount") / n_cells
    square = F.sum(F.col("logcount") * F.col("logcount")) / n_cells
    return logcounts.groupBy("gene_id").agg(mean.alias("mean"), F.greatest(square - mean * mean, F.lit(0.0)).alias("variance"))


def top_features(variances: DataFrame, n: int = 2000) -> DataFrame:
    """The n genes of highest variance, with their rank from 1; ties by name."""
    top = variances.orderBy(F.desc("variance"), "gene_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "gene_id")).cast("long"))


def lowess(x: np.ndarray, y: np.ndarray, n: np.ndarray, span: float = 0.3, rounds: int = 3) -> np.ndarray:
    """Locally linear fit at each x of means y of n values, tricube weights over the nearest share of them, with bisquare rounds (Cleveland 1979)."""
    firm, fit = np.ones(len(x)), y
    for _ in range(rounds + 1):
        fit = np.empty(len(x))
        for i, own in enumerate(x):
            far = np.abs(x - own)
            order = np.argsort(far, kind="stable")
            reach = far[order[min(len(x) - 1, int(np.searchsorted(np.cumsum(n[order]), span * n.sum())))]]
            w = n * firm * np.clip(1 - (far / max(reach * 1.0000001, 1e-12)) ** 3, 0, None) ** 3
            centre = (w * x).sum() / w.sum()
            spread = (w * (x - centre) ** 2).sum()
            slope = (w * (x - centre) * y).sum() / spread if spread > 1e-12 * w.sum() else 0.0
            fit[i] = (w * y).sum() / w.sum() + slope * (own - centre)
        off = np.abs(y - fit)
        order = np.argsort(off, kind="stable")
        middle = off[order[int(np.searchsorted(np.cumsum(n[order]), n.sum() / 2))]]
        firm = np.clip(1 - (off / (6 * middle)) ** 2, 0, None) ** 2 if middle > 0 else np.ones(len(x))
        firm = np.maximum(firm, 1e-6)
    return fit


def variance_residuals(variances: DataFrame, minimum: float = 0.1, span: float = 0.3) -> DataFrame:
    """variances (gene_id, mean, variance and others) with fitted, the variance that a trend along the mean gives, and residual.

    The trend is a local fit to fourth roots, which large variances sway less, of genes of mean `minimum` or more; below, it goes straight to zero. Genes are dealt to BINS ranges of the
    mean, whose sums are all that the driver sees; with fewer genes each is a range of its own.
    """
    used = variances.where((F.col("mean") >= minimum) & (F.col("variance") > 0)).select("mean", "variance")
    bounds = np.array(bounds_of(used, "mean", BINS))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            part = np.searchsorted(bounds, frame["mean"].to_numpy())
            yield pd.DataFrame({"part": part, "n": 1.0, "x": frame["mean"], "y": frame["variance"] ** 0.25}).groupby("part", as_index=False).sum()

    got = used.mapInPandas(sums, "part long, n double, x double, y double").groupBy("part").agg(*(F.sum(c).alias(c) for c in "nxy")).orderBy("part").toPandas()  # BINS rows
    if got.empty:
        return variances.withColumn("fitted", F.lit(0.0)).withColumn("residual", F.col("variance"))
    x = (got.x / got.n).to_numpy()
    fit = np.maximum(lowess(x, (got.y / got.n).to_numpy(), got.n.to_numpy(), span), 0)

    @F.pandas_udf("double")
    def fitted(mean: pd.Series) -> pd.Series:
        at = np.maximum(mean.to_numpy(float), minimum)
        return pd.Series(np.interp(at, x, fit) ** 4 * np.minimum(mean.to_numpy(float) / minimum, 1.0))

    return variances.withColumn("fitted", fitted("mean")).withColumn("residual", F.col("variance") - F.col("fitted"))


def select_features(logcounts: DataFrame, genes: DataFrame, n_cells: int, feature_set: str = "hvg", n: int = 2000, by: str = "variance") -> DataFrame:
    """(gene_id) chosen: all genes; or, if genes has an is_hvg that holds for some, those, whatever n; or the n of highest variance or residual.

    genes: gene_id, optionally is_hvg. by: variance, or residual, what the variance has beyond the trend along the mean. Genes without a row of logcounts have variance 0; ties go by name.
    """
    if by not in ("variance", "residual"):
        raise ValueError(f"genes are chosen by variance or residual, not by {by}")
    if feature_set == "all":
        return genes.select("gene_id")
    if feature_set != "hvg":
        raise ValueError(f"unknown feature set {feature_set}")
    if "is_hvg" in genes.columns:
        cached = genes.where("is_hvg").select("gene_id")
        if not cached.isEmpty():
            return cached
    variance = genes.select("gene_id").join(gene_variance(logcounts, n_cells), "gene_id", "left").na.fill(0.0, ["mean", "variance"])
    if by == "residual":
        variance = variance_residuals(variance).select("gene_id", F.col("residual").alias("variance"))
    return top_features(variance, n).select("gene_id")


def scale_to_unit(df: DataFrame, column: str, to: str) -> DataFrame:
    """Min-max scale; nulls stay, a constant column becomes 0."""
    ends = df.agg(F.min(column).alias("low__"), F.max(column).alias("high__"))
    both = df.crossJoin(F.broadcast(ends))  # one row
    unit = F.when(F.col("high__") == F.col("low__"), F.col(column) * 0).otherwise((F.col(column) - F.col("low__")) / (F.col("high__") - F.col("low__")))
    return both.withColumn(to, unit).drop("low__", "high__")


def safe_scale(df: DataFrame, column: str, to: str) -> DataFrame:
    """z-score with the sample deviation; missing values take the median first; a column without spread gives null."""
    centre = df.agg(F.median(column).alias("m__"))
    filled = df.crossJoin(F.broadcast(centre)).withColumn(to, F.coalesce(column, "m__")).drop("m__")
    moments = filled.agg(F.avg(to).alias("a__"), F.stddev_samp(to).alias("s__"))
    z = F.when(F.col("s__") > 0, (F.col(to) - F.col("a__")) / F.col("s__"))
    return filled.crossJoin(F.broadcast(moments)).withColumn(to, z).drop("a__", "s__")
