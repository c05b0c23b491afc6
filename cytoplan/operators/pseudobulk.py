"""Pseudobulk aggregation, log-CPM, filters and multiple-testing correction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.functions.settle import small


def pseudobulk(cells: DataFrame, counts: DataFrame, keys: list[str], how: str = "sum", min_cells: int = 1, prefix: str = "pb_", check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(samples, values): groups of complete-case cells, named in the order of their keys, and gene totals (or means) of each."""
    used = cells.dropna(subset=keys).select("cell_id", *keys)
    if check and used.isEmpty():
        raise ValueError("no cell has a value in every grouping column")
    groups = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("ncells")).where(F.col("ncells") >= min_cells)
    # The sample table is small: a row for each group.
    number = F.row_number().over(Window.orderBy(*keys))
    samples = groups.withColumn("pb_sample_id", F.concat(F.lit(prefix), number.cast("string")))
    by_cell = used.join(samples, keys).select("cell_id", "pb_sample_id", "ncells")
    value = F.sum("value") if how == "sum" else F.sum("value") / F.first("ncells")
    values = counts.join(by_cell, "cell_id").groupBy("pb_sample_id", "gene_id").agg(value.alias("value"))
    return samples, values


def library_sizes(values: DataFrame) -> DataFrame:
    return values.groupBy("pb_sample_id").agg(F.sum("value").alias("lib_size"))


def filter_samples(samples: DataFrame, values: DataFrame, min_cells: int = 10, min_lib_size: float | None = None) -> DataFrame:
    full = samples.join(library_sizes(values), "pb_sample_id", "left").na.fill(0.0, ["lib_size"]).where(F.col("ncells") >= min_cells)
    return full if min_lib_size is None else full.where(F.col("lib_size") >= min_lib_size)


def log_cpm(values: DataFrame, prior_count: float = 2.0) -> DataFrame:
    """log2 counts per million with a prior in proportion to library size; every gene of every sample has a value."""
    sizes = library_sizes(values)
    mean = sizes.agg(F.avg("lib_size").alias("mean_size"))
    grid = values.select("gene_id").distinct().crossJoin(small(sizes.crossJoin(mean), "samples"))
    full = grid.join(values, ["pb_sample_id", "gene_id"], "left").na.fill(0.0, ["value"])
    prior = prior_count * F.col("lib_size") / F.col("mean_size")
    return full.select("pb_sample_id", "gene_id", F.log2((F.col("value") + prior) / (F.col("lib_size") + 2 * prior) * 1e6).alias("logcpm"))


def benjamini_hochberg(df: DataFrame, p: str, tie: str, by: list[str], to: str = "fdr") -> DataFrame:
    """Adjusted p values within each group of `by` (a contrast): running minimum of p * n / rank from the largest down."""
    up = Window.partitionBy(*by).orderBy(p, tie)
    n = F.count(p).over(Window.partitionBy(*by))
    raw = df.withColumn("raw__", F.col(p) * n / F.row_number().over(up))
    down = Window.partitionBy(*by).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(to, F.least(F.lit(1.0), F.min("raw__").over(down))).drop("raw__")


def quantiles_by(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    q = lambda x: F.percentile(column, F.lit(x))
    return df.groupBy(*keys).agg(q(0.25).alias("q25"), F.median(column).alias("median"), q(0.75).alias("q75"))


def normalised_crosstab(df: DataFrame, truth: str, predicted: str, by: str = "row") -> DataFrame:
    """Counts of all combinations of levels, and their share of the truth's row, of the predicted column, or (by="none") the count itself."""
    levels = df.select(truth).distinct().crossJoin(small(df.select(predicted).distinct(), "levels"))
    full = levels.join(df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n")), [truth, predicted], "left").na.fill(0, ["n"])
    if by == "none":
        return full.withColumn("share", F.col("n").cast("double"))
    side = {"row": truth, "column": predicted}[by]
    return full.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy(side)), F.lit(1)))
