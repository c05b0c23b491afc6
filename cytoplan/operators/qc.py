"""Per-cell quality metrics and cell filters over a sparse count table (cell_id, gene_id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

# Gene-name prefixes of ribosomal RNA and ribosomal proteins.
RRNA_PATTERN, RIBO_PATTERN = "^(rrs|rrl|rrf)", "^(rpl|rps)"


def qc_metrics(cells: DataFrame, counts: DataFrame, rrna_pattern: str = RRNA_PATTERN, ribo_pattern: str = RIBO_PATTERN) -> DataFrame:
    """Eight metrics for every cell; a cell without counts gets zeros, never NaN."""
    of = lambda pattern: F.sum(F.when(F.col("gene_id").rlike(f"(?i){pattern}"), F.col("value")))
    sums = counts.groupBy("cell_id").agg(
        F.sum("value").alias("total_counts"),
        F.count(F.when(F.col("value") > 0, 1)).alias("detected_features"),
        of(rrna_pattern).alias("rrna_counts"),
        of(ribo_pattern).alias("ribo_counts"),
    )
    full = cells.select("cell_id").join(sums, "cell_id", "left").na.fill(0)
    share = lambda c: F.col(c) / F.greatest("total_counts", F.lit(1.0))
    return full.select(
        "cell_id", "total_counts", "detected_features", "rrna_counts", share("rrna_counts").alias("rrna_fraction"),
        (100 * share("rrna_counts")).alias("pct_rrna"), "ribo_counts", share("ribo_counts").alias("ribo_fraction"), (100 * share("ribo_counts")).alias("pct_ribo"),
    )


# Classes of genes that count as ribosomal RNA and as ribosomal proteins.
RRNA_CLASSES, RIBO_CLASSES = ("rrna", "r_rna", "ribosomal_rna"), ("ribo", "ribosomal_protein", "ribo_protein")


def qc_metrics_by_class(cells: DataFrame, counts: DataFrame, genes: DataFrame, gene_class: str) -> DataFrame:
    """The metrics of qc_metrics, with genes told by a column of genes (gene_id, ...) instead of their names."""
    if gene_class not in genes.columns:
        raise ValueError(f"the genes have no column {gene_class}")
    kind = F.lower(F.col(gene_class).cast("string"))
    name = F.when(kind.isin(*RRNA_CLASSES), "rrna").when(kind.isin(*RIBO_CLASSES), "ribo").otherwise("other")
    of = genes.select("gene_id", name.alias("kind__"))
    # What qc_metrics looks at are names: a gene's kind and a number that tells genes apart stand for it.
    told = counts.join(of, "gene_id", "left").select("cell_id", F.coalesce("kind__", F.lit("other")).alias("gene_id"), "value")
    return qc_metrics(cells, told, "^rrna$", "^ribo$")


def filter_summary(metrics: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: kept_cells and removed_cells of a filter."""
    after = kept.agg(F.count(F.lit(1)).alias("kept_cells"))
    return metrics.agg(F.count(F.lit(1)).alias("all")).crossJoin(after).select("kept_cells", (F.col("all") - F.col("kept_cells")).alias("removed_cells"))  # one row each


def filter_cells(
    metrics: DataFrame, min_counts: float | None = None, min_features: int | None = None, max_rrna_fraction: float | None = None, custom: Column | str | None = None
) -> DataFrame:
    """Cells within all bounds, which are inclusive; custom is a boolean column or its name."""
    out = metrics
    if min_counts is not None:
        out = out.where(F.col("total_counts") >= min_counts)
    if min_features is not None:
        out = out.where(F.col("detected_features") >= min_features)
    if max_rrna_fraction is not None:
        out = out.where(F.col("rrna_fraction") <= max_rrna_fraction)
    return out if custom is None else out.where(F.col(custom) if isinstance(custom, str) else custom)
