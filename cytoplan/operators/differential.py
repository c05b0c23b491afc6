"""Contrasts, library-size normalisation and fitted curves of pseudobulk samples. values: pb_sample_id, gene_id, value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.functions.settle import small
from cytoplan.operators.pseudobulk import library_sizes


def contrast_pairs(levels: DataFrame, kind: str = "reference", reference: str | None = None, manual: list[tuple[str, str]] | None = None) -> DataFrame:
    """(group1, group2, contrast): each level against the reference, or each later level against each earlier. levels: position, level."""
    if kind == "manual":
        if not manual:
            raise ValueError("manual contrasts need pairs")
        pairs = levels.sparkSession.createDataFrame(manual, "group1 string, group2 string")
    elif kind == "reference":
        first = levels.orderBy("position").select("level").limit(1) if reference is None else levels.where(F.col("level") == reference).select("level")
        if first.isEmpty():
            raise ValueError("the reference is not among the levels")
        pairs = levels.crossJoin(F.broadcast(first.toDF("group2"))).where("level != group2").select(F.col("level").alias("group1"), "group2")  # one row
    elif kind == "all":
        a, b = levels.toDF("p1", "group1"), levels.toDF("p2", "group2")
        pairs = a.join(b, F.col("p1") > F.col("p2")).select("group1", "group2")
    else:
        raise ValueError(f"unknown contrasts {kind}")
    return pairs.withColumn("contrast", F.concat("group1", F.lit("_vs_"), "group2"))


def _grid(values: DataFrame) -> DataFrame:
    """Every gene of every sample, with the library size; samples are few."""
    found = values.select("gene_id").distinct().crossJoin(small(library_sizes(values), "samples"))
    return found.join(values, ["pb_sample_id", "gene_id"], "left").na.fill(0.0, ["value"])


def _average_rank(column: str) -> F.Column:
    own = Window.partitionBy("pb_sample_id")
    return F.rank().over(own.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy("pb_sample_id", column)) - 1) / 2


def norm_factors(values: DataFrame, method: str = "tmm", trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """(pb_sample_id, lib_size, norm_factor): factors of geometric mean 1.

    tmm: weighted mean of the log ratios to a reference sample, without the highest and lowest ratios and means
    (Robinson and Oshlack 2010); the reference's upper quartile is nearest to the mean of all. upperquartile: that quartile itself.
    """
    sizes = library_sizes(values)
    if method == "none":
        return sizes.withColumn("norm_factor", F.lit(1.0))
    grid = _grid(values)
    quartile = grid.groupBy("pb_sample_id").agg(F.percentile(F.col("value") / F.col("lib_size"), F.lit(0.75)).alias("q"))
    if method == "upperquartile":
        raw = quartile.select("pb_sample_id", F.col("q").alias("f"))
    elif method == "tmm":
        near = quartile.crossJoin(F.broadcast(quartile.agg(F.avg("q").alias("mean")))).withColumn("d", F.round(F.abs(F.col("q") - F.col("mean")), 15))
        ref = near.orderBy("d", "pb_sample_id").select(F.col("pb_sample_id").alias("ref")).limit(1)
        other = grid.join(F.broadcast(ref), F.col("pb_sample_id") == F.col("ref")).select("gene_id", F.col("value").alias("y"), F.col("lib_size").alias("m"))
        both = grid.where("value > 0").join(other.where("y > 0"), "gene_id")
        a, b = F.col("value") / F.col("lib_size"), F.col("y") / F.col("m")
        ratio = both.select(
            "pb_sample_id", F.round(F.log2(a / b), 12).alias("ratio"), F.round((F.log2(a) + F.log2(b)) / 2, 12).alias("mean"),
            (1 / F.col("value") - 1 / F.col("lib_size") + 1 / F.col("y") - 1 / F.col("m")).alias("v"),
        )
        n = F.count(F.lit(1)).over(Window.partitionBy("pb_sample_id"))
        ranked = ratio.select("pb_sample_id", "ratio", "v", _average_rank("ratio").alias("rm"), _average_rank("mean").alias("ra"), n.alias("n"))
        inside = lambda r, trim: F.col(r).between(F.floor(F.col("n") * trim) + 1, F.col("n") - F.floor(F.col("n") * trim))
        kept = F.when(inside("rm", trim_m) & inside("ra", trim_a) & (F.col("v") > 0), 1 / F.when(F.col("v") > 0, F.col("v")))
        mean = F.try_divide(F.sum(F.col("ratio") * kept), F.sum(kept))
        raw = ranked.groupBy("pb_sample_id").agg(F.when(F.max(F.abs("ratio")) < 1e-6, 1.0).otherwise(F.pow(F.lit(2.0), F.coalesce(mean, F.lit(0.0)))).alias("f"))
        raw = sizes.select("pb_sample_id").join(raw, "pb_sample_id", "left").na.fill(1.0, ["f"])
    else:
        raise ValueError(f"unknown method {method}")
    middle = raw.agg(F.exp(F.avg(F.log("f"))).alias("g"))
    return sizes.join(raw, "pb_sample_id").crossJoin(F.broadcast(middle)).select("pb_sample_id", "lib_size", (F.col("f") / F.col("g")).alias("norm_factor"))


def normalised_log_cpm(values: DataFrame, factors: DataFrame, prior_count: float = 2.0) -> DataFrame:
    """log2 counts per million of library sizes times factors."""
    sizes = factors.select("pb_sample_id", (F.col("lib_size") * F.col("norm_factor")).alias("size"))
    full = _grid(values).join(sizes.crossJoin(F.broadcast(sizes.agg(F.avg("size").alias("mean")))), "pb_sample_id")  # one row
    prior = prior_count * F.col("size") / F.col("mean")
    return full.select("pb_sample_id", "gene_id", F.log2((F.col("value") + prior) / (F.col("size") + 2 * prior) * 1e6).alias("logcpm"))


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interpolating cubic through (x, y) with straight ends: constant for one point, a line for two."""
    if len(x) == 1:
        return np.full(len(at), y[0])
    if len(x) == 2:
        return np.interp(at, x, y)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    system = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    bend = np.concatenate(([0.0], np.linalg.solve(system, 6 * np.diff(slope)), [0.0]))
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    left, right = at - x[k], x[k + 1] - at
    return (bend[k] * right**3 + bend[k + 1] * left**3) / (6 * h[k]) + (y[k] / h[k] - bend[k] * h[k] / 6) * right + (y[k + 1] / h[k] - bend[k + 1] * h[k] / 6) * left


def interpolated_curves(values: DataFrame, grid: int = 200) -> DataFrame:
    """(condition, gene_id, time, value): means of each time point, interpolated over the condition's span. values: condition, gene_id, time, value.

    A group is one gene's means, a row for each time point, after they are aggregated.
    """
    means = values.where("time is not null and value is not null").groupBy("condition", "gene_id", "time").agg(F.avg("value").alias("value"))
    span = values.where("time is not null").groupBy("condition").agg(F.min("time").cast("double").alias("low"), F.max("time").cast("double").alias("high"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("time")
        at = np.linspace(f.low.iloc[0], f.high.iloc[0], grid)
        got = natural_spline(f.time.to_numpy(float), f.value.to_numpy(float), at)
        return pd.DataFrame({"condition": f.condition.iloc[0], "gene_id": f.gene_id.iloc[0], "time": at, "value": got})

    joined = means.join(F.broadcast(span), "condition").select("condition", "gene_id", F.col("time").cast("double").alias("time"), "value", "low", "high")
    return joined.groupBy("condition", "gene_id").applyInPandas(fit, "condition string, gene_id string, time double, value double")
