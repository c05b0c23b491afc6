"""Gene trends along branches, their clusters, and the space of cells that joins embedding, pseudotime and branches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.functions.settle import small
from cytoplan.functions.smoothing import smoothing_spline
from cytoplan.operators.features import scale_to_unit
from cytoplan.operators.reduction import kmeans, pca

#: Pseudotimes are told apart to this many digits, so that a gene's curve is fitted on a bounded number of rows.
DIGITS = 4
#: Smoothing of the splines that stand in for local fits.
SPAR = 0.6


def local_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, grid: np.ndarray, span: float = 0.5) -> np.ndarray:
    """Local quadratic regression with tricube weights (Cleveland 1979) of means y, of n cells of total weight w each, at the grid.

    Beyond the data the curve goes on at its end's height; where a local fit is singular, one of lower degree serves. Where no place has a fit, a smoothing spline
    serves, and the weighted mean where that has none, either.
    """
    wanted = max(1.0, np.floor(min(span, 1.0) * n.sum() + 1e-5))
    out = np.full(len(grid), np.nan)
    for i, g in enumerate(grid):
        if g < x[0] - 1e-12 or g > x[-1] + 1e-12:
            continue
        d = np.abs(x - g)
        order = np.argsort(d, kind="stable")
        reach = d[order][min(len(x) - 1, int(np.searchsorted(np.cumsum(n[order]), wanted)))] * max(1.0, span)
        local = w * (1 - np.minimum(d / max(reach * 1.0000001, 1e-9), 1) ** 3) ** 3
        for degree in (2, 1, 0):
            a = np.vander(x - g, degree + 1, increasing=True) * np.sqrt(local)[:, None]
            if (local > 0).sum() > degree and np.linalg.matrix_rank(a) == degree + 1:
                out[i] = np.linalg.lstsq(a, y * np.sqrt(local), rcond=None)[0][0]
                break
    some = np.isfinite(out)
    if some.any():
        return np.interp(grid, grid[some], out[some])
    if len(x) >= 4 and np.isfinite(spline := smoothing_spline(x, y, w, at=grid, spar=SPAR)).all():
        return spline
    return np.full(len(grid), np.average(y, weights=w))


def gene_trends(
    values: DataFrame, genes: list[str], cells: DataFrame, probabilities: DataFrame, minimum: float = 0.05, grid: int = 100, span: float = 0.5
) -> DataFrame:
    """(gene_id, branch, pseudotime, value, n_cells): each gene's smooth course along each branch.

    values: id, gene_id, value (no rows for zeros); cells: id, cluster, pt from 0 to 1; probabilities: cluster, branch, p. A branch's
    cells are those of probability `minimum` or more, weighted by it; a curve needs ten of them at four times that differ.
    """
    chosen = values.sparkSession.createDataFrame([(g,) for g in dict.fromkeys(genes)], "gene_id string")
    own = values.join(F.broadcast(chosen), "gene_id", "left_semi")  # the genes asked for
    found = chosen.join(own.select("gene_id").distinct(), "gene_id", "left_semi")
    bin_ = F.round("pt", DIGITS)
    member = cells.where("pt is not null and not isnan(pt)").join(probabilities.select("cluster", "branch", "p"), "cluster").where(F.col("p") >= minimum).select("id", "branch", "p", bin_.alias("pt"))
    bins = member.groupBy("branch", "pt").agg(F.sum("p").alias("w"), F.count(F.lit(1)).alias("n"))
    sums = own.join(member, "id").groupBy("gene_id", "branch", "pt").agg(F.sum(F.col("p") * F.col("value")).alias("wy"))
    full = bins.crossJoin(small(found, "genes")).join(sums, ["gene_id", "branch", "pt"], "left").na.fill(0.0, ["wy"])
    at = np.linspace(0, 1, grid)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("pt")
        if f.n.sum() < 10 or f.pt.round(3).nunique() < 4:
            return pd.DataFrame({"gene_id": [], "branch": [], "pseudotime": [], "value": [], "n_cells": []})
        y = local_curve(f.pt.to_numpy(), (f.wy / f.w).to_numpy(), f.w.to_numpy(), f.n.to_numpy(float), at, span)
        return pd.DataFrame({"gene_id": f.gene_id.iloc[0], "branch": f.branch.iloc[0], "pseudotime": at, "value": y, "n_cells": int(f.n.sum())})

    return full.groupBy("gene_id", "branch").applyInPandas(fit, "gene_id string, branch string, pseudotime double, value double, n_cells long")


def trend_rows(trends: DataFrame) -> DataFrame:
    """trends with z, the value against its gene's and branch's mean and deviation; 0 without any."""
    own = Window.partitionBy("gene_id", "branch")
    spread = F.stddev_samp("value").over(own)
    return trends.withColumn("z", F.when(spread > 0, (F.col("value") - F.avg("value").over(own)) / spread).otherwise(0.0))


def trend_clusters(trends: DataFrame, k: int = 4, seed: int = 1) -> DataFrame:
    """(gene_id, trend_cluster, from 1 on): k-means of the courses; of several branches the first by name counts."""
    courses = trend_rows(trends).groupBy("gene_id", "branch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pseudotime", "z"))), lambda x: x["z"]).alias("v"))  # one grid
    named = courses.select(F.struct("gene_id", "branch").alias("id"), "v")
    count = named.count()
    if not count:
        raise ValueError("there are no trends to group")
    got = kmeans(named, min(k, count), seed)
    return got.groupBy("id.gene_id").agg((F.min_by("k", "id.branch") + 1).alias("trend_cluster"))


def safe_scaled(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """df with the array column's places z-scored and those without spread dropped; and how many are left.

    Missing and infinite values take their place's median. A few numbers for each place reach the driver.
    """
    long = df.select(F.posexplode(column).alias("k", "x"))
    finite = F.when(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    facts = long.withColumn("x", finite).groupBy("k").agg(F.median("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("x").alias("n")).orderBy("k").collect()
    kept = [r for r in facts if r.n > 1 and (r.s or 0) > 0]
    if not kept:
        return df.withColumn(column, F.array().cast("array<double>")), 0

    def at(r) -> F.Column:
        x = F.get(column, F.lit(r.k))
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(float(r.m)))

    filled = df.withColumn(column, F.array(*(at(r) for r in kept)))
    moments = filled.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("a"), F.stddev_samp("x").alias("s")).orderBy("k").collect()
    scaled = [((F.get(column, F.lit(r.k)) - F.lit(r.a)) / F.lit(r.s)) if r.s else F.lit(0.0) for r in moments]
    return filled.withColumn(column, F.array(*scaled)), len(kept)


def cell_space(cells: DataFrame, components: int = 5) -> DataFrame:
    """(cell_id, embedding): principal components of the first five dimensions, the pseudotime and the branch probabilities.

    cells: id, v, and optionally pt and p (an array, a place for each branch), of which p weighs 0.6.
    """
    parts, frame = [], cells.withColumn("d__", F.transform(F.slice("v", 1, 5), lambda x: x.cast("double")))
    frame, n = safe_scaled(frame, "d__")
    parts += [F.col("d__")] if n else []
    if "pt" in cells.columns:
        frame = scale_to_unit(frame, "pt", "u__")
        parts.append(F.array("u__"))
    if "p" in cells.columns:
        frame, n = safe_scaled(frame.withColumn("q__", F.col("p")), "q__")
        parts += [F.transform("q__", lambda x: 0.60 * x)] if n else []
    both, n = safe_scaled(frame.select(F.col("id").alias("cell_id"), F.concat(*parts).alias("x")), "x") if parts else (None, 0)
    if n == 0:
        return cells.select(F.col("id").alias("cell_id"), F.array(F.lit(0.0)).alias("embedding"))
    return both.select("cell_id", F.col("x").alias("embedding")) if n == 1 else pca(both, min(components, n), scale=False)[0]
