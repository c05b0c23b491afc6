"""Queries on names and annotations of incoming tables, merged embeddings, layouts, the trend of variances, neighbours by the index and tables for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplan.operators import features, ingest, layout, merge, nearindex, plotdata, pseudotime, reduction
from cytoplan.plans.extended import _DE, _TREND, _de
from cytoplan.plans.registry import POINTS, _nn, query, rounded
from cytoplan.plans.trajectories import _graph
from cytoplan.sources import tables


@query(
    """WITH n AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_brand END AS name FROM part)
SELECT position, name || CASE WHEN row_number() OVER w > 1 THEN '.' || (row_number() OVER w - 1) ELSE '' END AS feature FROM n WINDOW w AS (PARTITION BY name ORDER BY position)"""
)
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part")
    genes = p.select(F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).otherwise(" ").alias("gene_name"), F.lit(None).cast("string").alias("Symbol"), F.col("p_type").alias("maker"))
    return ingest.feature_names(genes, "position", current="maker").select("position", "feature")


@query(
    """SELECT c_custkey AS position, c_mktsegment || CASE WHEN row_number() OVER w > 1 THEN '.' || (row_number() OVER w - 1) ELSE '' END AS cell_id FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey)"""
)
def cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("barcode"))
    return ingest.cell_names(c, "position").select("position", "cell_id")


@query("SELECT c_custkey AS cell_id, c_mktsegment AS kind, round(c_acctbal, 6) AS balance, 'one' AS batch, 3::BIGINT AS age FROM customer")
def aligned_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer")
    facts = c.select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"))
    cells = ingest.aligned(facts, tables.count_cells(spark, sf_dir), "cell_id", "metadata")
    return rounded(ingest.annotated(cells, {"batch": None, "time": "age", "condition": "kind"}, {"batch": "one", "time": 3}).select("cell_id", "kind", "balance", "batch", "age"))


_HALVES = f"{POINTS}, part AS (SELECT id, CASE WHEN cluster % 2 = 0 THEN 'even' ELSE 'odd' END AS half, v FROM points)"


@query(f"WITH {_HALVES} SELECT half || '_' || id AS cell_id, k AS dim, CASE WHEN id % 3 > 0 THEN round(v[k], 6) END AS value FROM part, range(1, 65) r(k) WHERE id % 3 > 0 OR k = 1")
def merged_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings of two objects whose cells are merged; one cell in three has none. An embedding of the first alone is left out."""
    points = tables.points(spark, sf_dir).withColumn("half", F.when(F.col("cluster") % 2 == 0, "even").otherwise("odd"))
    objects = []
    for half in ("even", "odd"):
        own = points.where(F.col("half") == half)
        reductions = {"PCA": own.where("id % 3 > 0").select(F.col("id").alias("cell_id"), F.col("v").alias("embedding"))}
        reductions |= {"first": reductions["PCA"].select("cell_id", F.slice("embedding", 1, 1 if half == "even" else 2).alias("embedding"))}
        objects.append((own.select(F.concat_ws("_", "half", F.col("id").cast("string")).alias("cell_id"), F.col("id").alias("original_cell_id")), reductions))
    kept, skipped = merge.merge_reductions(objects)
    if set(kept) != {"PCA"} or set(skipped) != {"first"}:
        raise ValueError("embeddings of different lengths must be left out")
    return rounded(kept["PCA"].select("cell_id", F.posexplode_outer("embedding").alias("k", "value")).select("cell_id", (F.coalesce("k", F.lit(0)) + 1).cast("long").alias("dim"), "value"))


@query(f"WITH {POINTS} SELECT id AS cell_id, round(v[1], 6) AS x, round(v[2], 6) AS y, cluster FROM points")
def reduction_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir).withColumnRenamed("id", "cell_id")
    return rounded(plotdata.reduction_data(points, points.select("cell_id", F.col("v").alias("embedding")), "cluster", shuffle_seed=1).drop("draw_order"))


@query(
    f"""WITH {_DE}, {_TREND}, top AS (SELECT p_brand AS gene_id, min(fdr) AS fdr FROM de JOIN part ON p_partkey = de.gene_id GROUP BY 1 ORDER BY fdr, gene_id LIMIT 6)
SELECT gene_id, branch, round(pseudotime, 6) AS pseudotime, round(value, 6) AS value FROM tr WHERE gene_id IN (SELECT gene_id FROM top)"""
)
def curve_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part")
    curves = p.groupBy(F.col("p_brand").alias("gene_id"), (F.col("p_partkey") % 2).cast("string").alias("branch"), (F.col("p_size") % 10 / 10.0).alias("pseudotime")).agg(F.round(F.avg("p_retailprice"), 6).alias("value"))
    table = _de(spark, sf_dir).join(p.select(F.col("p_partkey").alias("gene_id"), "p_brand"), "gene_id").select(F.col("p_brand").alias("gene_id"), "fdr")
    return rounded(plotdata.curve_data(table, curves))


@query()
def variance_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = features.log_normalise(tables.counts(spark, sf_dir))
    return rounded(features.variance_residuals(features.gene_variance(logs, tables.count_cells(spark, sf_dir).count()), minimum=0.01))


@query()
def cluster_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, edges = _graph(spark, sf_dir)
    return rounded(pseudotime.closeness(edges, points.select("cluster").distinct()))


@query()
def umap_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir)
    scores, _ = reduction.pca(points.select(F.col("id").alias("cell_id"), F.col("v").alias("x")), 2)
    start = scores.select(F.col("cell_id").alias("id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return rounded(layout.umap(points.select("id", "v"), start), 4)


@query()
def knn_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every point, how many of its 15 nearest the index finds with cells of some fifty points, most of which it does not look into."""
    points, exact = _nn(spark, sf_dir)
    found = nearindex.knn_indexed(points.select("id", "v"), cell=50)
    hits = exact.select("i", "j").join(found.select("i", "j"), ["i", "j"]).groupBy("i").agg(F.count(F.lit(1)).alias("found"))
    n = exact.groupBy("i").agg(F.count(F.lit(1)).alias("wanted")).join(hits, "i", "left").na.fill(0, ["found"])
    recall = n.agg((F.sum("found") / F.sum("wanted")).alias("recall"))
    return rounded(n.crossJoin(F.broadcast(recall)))  # one row
