"""Queries on contrasts, normalisation factors, curves and principal components, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.operators import differential, features, metrics, reduction
from cytoplan.plans.registry import _PB, _pseudobulk, query, rounded
from cytoplan.sources import tables

_LEVELS = "lv AS (SELECT o_orderpriority AS level, row_number() OVER (ORDER BY o_orderpriority) AS position FROM (SELECT DISTINCT o_orderpriority FROM orders))"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = tables.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level")).distinct()
    return level.select(F.row_number().over(Window.orderBy("level")).alias("position"), "level")


@query(f"WITH {_LEVELS} SELECT a.level AS group1, b.level AS group2, a.level || '_vs_' || b.level AS contrast FROM lv a JOIN lv b ON b.position = 1 AND a.position > 1")
def contrasts_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differential.contrast_pairs(_levels(spark, sf_dir))


@query(f"WITH {_LEVELS} SELECT a.level AS group1, b.level AS group2, a.level || '_vs_' || b.level AS contrast FROM lv a JOIN lv b ON a.position > b.position")
def contrasts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differential.contrast_pairs(_levels(spark, sf_dir), "all")


_QUARTILE = f"{_PB}, grid AS (SELECT s.pb_sample_id, g.gene_id, coalesce(value, 0) AS value, lib_size FROM size s CROSS JOIN (SELECT DISTINCT gene_id FROM pb) g LEFT JOIN pb ON pb.pb_sample_id = s.pb_sample_id AND pb.gene_id = g.gene_id), qt AS (SELECT pb_sample_id, quantile_cont(value / lib_size, 0.75) AS q FROM grid GROUP BY 1)"
_SCALED = "SELECT pb_sample_id, round(lib_size, 6) AS lib_size, round(f / (SELECT exp(avg(ln(f))) FROM raw), 6) AS norm_factor FROM size JOIN raw USING (pb_sample_id)"


@query(f"WITH {_QUARTILE}, raw AS (SELECT pb_sample_id, q AS f FROM qt) {_SCALED}")
def upper_quartile_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(differential.norm_factors(_pseudobulk(spark, sf_dir)[1], "upperquartile"))


_TMM = f"""{_QUARTILE}, ref AS (SELECT pb_sample_id FROM qt ORDER BY round(abs(q - (SELECT avg(q) FROM qt)), 15), pb_sample_id LIMIT 1), o AS (SELECT gene_id, value AS y, lib_size AS m FROM grid WHERE pb_sample_id IN (FROM ref) AND value > 0),
r AS (SELECT pb_sample_id, round(log2((value / lib_size) / (y / m)), 12) AS ratio, round((log2(value / lib_size) + log2(y / m)) / 2, 12) AS mean, 1 / value - 1 / lib_size + 1 / y - 1 / m AS v FROM grid JOIN o USING (gene_id) WHERE value > 0),
k AS (SELECT *, rank() OVER (PARTITION BY pb_sample_id ORDER BY ratio) + (count(*) OVER (PARTITION BY pb_sample_id, ratio) - 1) / 2 AS rm, rank() OVER (PARTITION BY pb_sample_id ORDER BY mean) + (count(*) OVER (PARTITION BY pb_sample_id, mean) - 1) / 2 AS ra, count(*) OVER (PARTITION BY pb_sample_id) AS n FROM r),
t AS (SELECT pb_sample_id, sum(ratio / v) / sum(1 / v) AS l FROM k WHERE rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) GROUP BY 1), raw AS (SELECT pb_sample_id, 2 ** coalesce(l, 0) AS f FROM size LEFT JOIN t USING (pb_sample_id))"""


@query(f"WITH {_TMM} {_SCALED}")
def tmm_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(differential.norm_factors(_pseudobulk(spark, sf_dir)[1], "tmm"))


@query(
    f"""WITH {_TMM}, z AS (SELECT pb_sample_id, lib_size * f / (SELECT exp(avg(ln(f))) FROM raw) AS s FROM size JOIN raw USING (pb_sample_id)), p AS (SELECT pb_sample_id, s, 2.0 * s / avg(s) OVER () AS prior FROM z)
SELECT pb_sample_id, gene_id, round(log2((value + prior) / (s + 2 * prior) * 1e6), 6) AS logcpm FROM grid JOIN p USING (pb_sample_id)"""
)
def tmm_logcpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _pseudobulk(spark, sf_dir)[1]
    return rounded(differential.normalised_log_cpm(values, differential.norm_factors(values)))


@query()
def interpolated_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("gene_id"), F.year("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    return rounded(differential.interpolated_curves(rows, 50))


@query()
def pca_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, logs = tables.count_cells(spark, sf_dir), features.log_normalise(tables.counts(spark, sf_dir))
    top = features.top_features(features.gene_variance(logs, cells.count()), 40)
    _, components = reduction.pca(reduction.cell_vectors(cells, logs, top), 10)
    return rounded(components.select("component", "share"))


@query()
def truncated_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten components of all genes: the sparse way, for cells by genes that fit in no dense vectors."""
    logs = features.log_normalise(tables.counts(spark, sf_dir))
    scores, _ = reduction.truncated_pca(tables.count_cells(spark, sf_dir), logs, logs.select("gene_id").distinct(), 10)
    return rounded(scores.select("cell_id", F.posexplode("embedding").alias("k", "score")).select("cell_id", (F.col("k") + 1).cast("long").alias("component"), F.abs("score").alias("size")), 4)


@query()
def kmeans_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir)
    found = reduction.kmeans(points, points.select("cluster").distinct().count())
    return rounded(metrics.agreement(points.join(found, "id"), "cluster", "k"))
