"""Queries on classes of genes, chosen features, refined clusters, plot tables, ingestion and whole workflows, with SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplan.functions import labels
from cytoplan.functions.settle import settled, shared_path
from cytoplan.operators import branching, expression, features, ingest, integration, merge, neighbors, plotdata, pseudobulk, qc, trajectory, trends
from cytoplan.plans import benchmark, tata, workflow
from cytoplan.plans.registry import _LOG, _PB, _QC, CELLS, COUNTS, POINTS, _metrics, _nn, _pseudobulk, _timed, query, rounded
from cytoplan.plans.trajectories import _GRAPH, _graph, by_dimension
from cytoplan.sources import experiment, matrixmarket, tables

_CLASS = "CASE length(gene_id) % 3 WHEN 0 THEN 'rRNA' WHEN 1 THEN 'ribosomal_protein' ELSE 'gene' END"


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.read(spark, sf_dir, "part").select(F.col("p_name").alias("gene_id")).distinct()
    kind = F.when(F.length("gene_id") % 3 == 0, "rRNA").when(F.length("gene_id") % 3 == 1, "ribosomal_protein").otherwise("gene")
    return own.select("gene_id", kind.alias("feature_class"), (F.length("gene_id") % 4 == 0).alias("is_hvg"))


@query(
    f"""WITH {CELLS}, {COUNTS}, s AS (SELECT c.cell_id, coalesce(sum(value), 0) AS total_counts, count(*) FILTER (value > 0) AS detected_features,
coalesce(sum(value) FILTER (length(gene_id) % 3 = 0), 0) AS rrna_counts, coalesce(sum(value) FILTER (length(gene_id) % 3 = 1), 0) AS ribo_counts FROM cells c LEFT JOIN counts USING (cell_id) GROUP BY 1),
q AS (SELECT *, rrna_counts / greatest(total_counts, 1.0) AS rrna_fraction, ribo_counts / greatest(total_counts, 1.0) AS ribo_fraction FROM s)
SELECT cell_id, round(total_counts, 6) AS total_counts, detected_features, round(rrna_counts, 6) AS rrna_counts, round(rrna_fraction, 6) AS rrna_fraction, round(100 * rrna_fraction, 6) AS pct_rrna,
round(ribo_counts, 6) AS ribo_counts, round(ribo_fraction, 6) AS ribo_fraction, round(100 * ribo_fraction, 6) AS pct_ribo FROM q"""
)
def qc_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.qc_metrics_by_class(tables.count_cells(spark, sf_dir), tables.counts(spark, sf_dir), _genes(spark, sf_dir), "feature_class"))


@query(f"SELECT count(*) FILTER (total_counts >= 500 AND detected_features >= 20) AS kept_cells, count(*) FILTER (NOT (total_counts >= 500 AND detected_features >= 20)) AS removed_cells FROM ({_QC})")
def filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _metrics(spark, sf_dir)
    return qc.filter_summary(found, qc.filter_cells(found, 500, 20))


@query("SELECT DISTINCT p_name AS gene_id FROM part WHERE length(p_name) % 4 = 0")
def cached_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.select_features(features.log_normalise(tables.counts(spark, sf_dir)), _genes(spark, sf_dir), 1)


@query(f"WITH {_LOG}, n AS (SELECT count(*) AS n FROM customer), v AS (SELECT gene_id, greatest(sum(logcount ** 2) / any_value(n) - (sum(logcount) / any_value(n)) ** 2, 0) AS v FROM logs CROSS JOIN n GROUP BY 1) SELECT p_name AS gene_id FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN v ON gene_id = p_name ORDER BY round(coalesce(v, 0), 9) DESC, p_name LIMIT 50")
def chosen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, cells = features.log_normalise(tables.counts(spark, sf_dir)), tables.read(spark, sf_dir, "customer").count()
    return features.select_features(logs, _genes(spark, sf_dir).drop("is_hvg"), cells, n=50)


_CROSS = "WITH t AS (SELECT c_mktsegment AS truth, r_name AS predicted FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), l AS (SELECT * FROM (SELECT DISTINCT truth FROM t) CROSS JOIN (SELECT DISTINCT predicted FROM t)), c AS (SELECT truth, predicted, count(t.truth) AS n FROM l LEFT JOIN t USING (truth, predicted) GROUP BY 1, 2)"


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.count_cells(spark, sf_dir).select(F.col("condition").alias("truth"), F.col("batch").alias("predicted"))


@query(f"{_CROSS} SELECT truth, predicted, n, round(n / greatest(sum(n) OVER (PARTITION BY predicted), 1), 6) AS share FROM c")
def crosstab_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pseudobulk.normalised_crosstab(_cross(spark, sf_dir), "truth", "predicted", "column"))


@query(f"{_CROSS} SELECT truth, predicted, n, n::DOUBLE AS share FROM c")
def crosstab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pseudobulk.normalised_crosstab(_cross(spark, sf_dir), "truth", "predicted", "none"))


@query(f"WITH {_PB} SELECT pb_sample_id, gene_id, round(value / ncells, 6) AS value FROM pb JOIN samples USING (pb_sample_id)")
def pseudobulk_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pseudobulk.pseudobulk(tables.count_cells(spark, sf_dir), tables.counts(spark, sf_dir), ["batch", "condition"], "mean")[1])


@query(
    f"""WITH {_PB}, g AS (SELECT gene_id, count(*) FILTER (value / lib_size >= 10 / (SELECT median(lib_size) FROM size)) AS enough, sum(value) AS total FROM pb JOIN size USING (pb_sample_id) GROUP BY 1)
SELECT gene_id FROM g WHERE total >= 15 AND enough >= (SELECT min(n) FROM (SELECT count(*) AS n FROM samples GROUP BY batch))"""
)
def expressed_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, values = _pseudobulk(spark, sf_dir)
    design = expression.pairwise_design(samples, ["batch"])
    size = {r.pb_sample_id: r.lib_size for r in pseudobulk.library_sizes(values).collect()}  # a row for each sample
    import numpy as np

    rows = expression.gene_rows(values, design.samples)
    return expression.expressed(rows, np.array([size[s] for s in design.samples]), design.group).select("gene_id")


@query()
def pairwise_de(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(workflow.differential(tables.count_cells(spark, sf_dir), tables.counts(spark, sf_dir), ["batch", "condition"], group="condition")["table"], 4)


@query()
def spline_de(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tables.count_cells(spark, sf_dir).withColumn("time", (F.col("cell_id") % 6).cast("double"))
    return rounded(workflow.differential(cells, tables.counts(spark, sf_dir), ["batch", "time"], "time_series", time="time")["table"], 4)


_DE = "de AS (SELECT p_partkey AS gene_id, p_brand AS contrast, round(p_size / 10.0 - 2.5, 6) AS logfc, round((p_partkey * 7919 % 10007) / 10008.0, 6) AS fdr FROM part)"


def _de(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("contrast"), F.round(F.col("p_size") / 10.0 - 2.5, 6).alias("logfc"), F.round((F.col("p_partkey") * 7919 % 10007) / 10008.0, 6).alias("fdr"))


@query(
    f"""WITH {_DE} SELECT gene_id, contrast, logfc, fdr, round(-log10(greatest(fdr, 2.2250738585072014e-308)), 6) AS neg_log10_fdr,
CASE WHEN fdr <= 0.05 AND logfc >= 1 THEN 'Up' WHEN fdr <= 0.05 AND logfc <= -1 THEN 'Down' ELSE 'NotSig' END AS de_class, row_number() OVER (PARTITION BY contrast ORDER BY fdr, abs(logfc) DESC, gene_id) <= 10 AS labelled FROM de"""
)
def volcano_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plotdata.volcano_data(_de(spark, sf_dir)))


@query(f"WITH {_DE} SELECT gene_id, min(fdr) AS fdr FROM de GROUP BY 1 ORDER BY fdr, gene_id LIMIT 6")
def top_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.top_genes(_de(spark, sf_dir))


@query(f"WITH {_DE} SELECT gene_id, contrast, fdr AS logcpm, logfc, fdr <= 0.05 AS significant FROM de")
def ma_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.ma_data(_de(spark, sf_dir).withColumn("logcpm", F.col("fdr")))


_NODES = "nd0 AS (SELECT cluster, count(*) AS size, median(v[1]) AS x, median(v[2]) AS y FROM points GROUP BY 1), nd AS (SELECT *, CASE WHEN max(size) OVER () > min(size) OVER () THEN 4 + 6 * (size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) ELSE 7 END AS plot_size FROM nd0)"


@query(f"WITH {POINTS}, {_NODES} SELECT cluster, size, round(x, 6) AS x, round(y, 6) AS y, round(plot_size, 6) AS plot_size FROM nd")
def cluster_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plotdata.cluster_nodes(tables.points(spark, sf_dir)))


@query(
    f"""WITH {_GRAPH}, {_NODES} SELECT s AS from_cluster, e AS to_cluster, round(weight, 6) AS weight, ambiguous, round(a.x, 6) AS x, round(a.y, 6) AS y, round(b.x, 6) AS xend, round(b.y, 6) AS yend,
round(0.5 + 3 * weight / max(weight) OVER (), 6) AS plot_width FROM graph JOIN nd a ON a.cluster = s JOIN nd b ON b.cluster = e"""
)
def cluster_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, edges = _graph(spark, sf_dir)
    return rounded(plotdata.cluster_links(settled(edges.select("from_cluster", "to_cluster", "weight", "ambiguous")), plotdata.cluster_nodes(points)))


@query(
    f"""WITH {_GRAPH}, full_pairs AS (SELECT tw.f, tw.t, coalesce(observed, 0) AS observed, signed, consistency, coalesce(observed, 0) / (coalesce(x.d, 0) * coalesce(y.d, 0) / (SELECT sum(d) FROM dg) + 1e-8) AS topology_weight, (signed + 1) / 2 AS time_weight
FROM tw LEFT JOIN ob ON ob.f = tw.f AND ob.t = tw.t LEFT JOIN dg x ON x.c = tw.f LEFT JOIN dg y ON y.c = tw.t)
SELECT f AS from_cluster, t AS to_cluster, round(topology_weight, 6) AS topology_weight, round(signed, 6) AS signed, round(topology_weight * time_weight, 6) AS weight,
CASE WHEN observed > 0 AND topology_weight * time_weight >= 0.01 THEN 'kept' ELSE 'pruned' END AS edge_status, CASE WHEN abs(signed) <= 0.1 THEN 'ambiguous' WHEN signed >= 0 THEN 'forward' ELSE 'backward' END AS direction_group FROM full_pairs"""
)
def causality_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nn = _nn(spark, sf_dir)
    edges = neighbors.adjacency(nn)
    return rounded(plotdata.causality_data(trajectory.topology_weights(edges, points), trajectory.time_weights(edges, _timed(points))))


@query(f"WITH {POINTS}, t AS (SELECT time, (id * 37 % 101) / 100.0 AS pt FROM points) SELECT time, round(quantile_cont(pt, 0.25), 6) AS q25, round(median(pt), 6) AS median, round(quantile_cont(pt, 0.75), 6) AS q75 FROM t GROUP BY 1")
def calibration_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plotdata.calibration_data(tables.points(spark, sf_dir).select("time", (F.col("id") * 37 % 101 / 100.0).alias("pt"))))


_SHARES = "sh0 AS (SELECT cluster, unnest(['x', 'y']) AS branch, unnest([cluster / 10.0, 1 - cluster / 10.0]) AS p FROM (SELECT DISTINCT cluster FROM points))"


def _shares(points: DataFrame) -> DataFrame:
    c = points.select("cluster").distinct()
    return c.select("cluster", F.lit("x").alias("branch"), (F.col("cluster") / 10.0).alias("p")).union(c.select("cluster", F.lit("y"), 1 - F.col("cluster") / 10.0))


@query(f"WITH {POINTS}, {_SHARES}, top AS (SELECT id, cluster FROM points ORDER BY id * 37 % 101 DESC, id LIMIT 20) SELECT id, branch, round(p, 6) AS p FROM top JOIN sh0 USING (cluster)")
def branch_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir)
    return rounded(plotdata.branch_bars(points.withColumn("entropy", F.col("id") * 37 % 101), _shares(points)))


@query(f"WITH {POINTS}, {_SHARES} SELECT id, round(v[1], 6) AS x, round(v[2], 6) AS y, branch, round(p, 6) AS p FROM points JOIN sh0 USING (cluster)")
def branch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir)
    places = plotdata.reduction_data(points.select(F.col("id").alias("cell_id")), points.select(F.col("id").alias("cell_id"), F.col("v").alias("embedding"))).withColumnRenamed("cell_id", "id")
    return rounded(plotdata.branch_points(places, points, _shares(points)))


_TREND = "tr AS (SELECT p_brand AS gene_id, (p_partkey % 2)::VARCHAR AS branch, (p_size % 10) / 10.0 AS pseudotime, round(avg(p_retailprice), 6) AS value FROM part GROUP BY 1, 2, 3), z AS (SELECT *, coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0) AS z FROM tr WINDOW w AS (PARTITION BY gene_id, branch))"


@query(
    f"""WITH {_TREND}, pk AS (SELECT gene_id, arg_max(pseudotime, round(z, 6) * 1000 - pseudotime) AS peak FROM z GROUP BY 1), o AS (SELECT gene_id, row_number() OVER (ORDER BY peak, gene_id) AS row_order FROM pk)
SELECT gene_id, branch, round(pseudotime, 6) AS pseudotime, value, round(z, 6) AS z, 1::BIGINT AS trend_cluster, row_order FROM z JOIN o USING (gene_id)"""
)
def heatmap_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part")
    rows = p.groupBy(F.col("p_brand").alias("gene_id"), (F.col("p_partkey") % 2).cast("string").alias("branch"), (F.col("p_size") % 10 / 10.0).alias("pseudotime")).agg(F.round(F.avg("p_retailprice"), 6).alias("value"))
    return rounded(plotdata.heatmap_data(rows))


@query("SELECT o_orderkey AS id, dense_rank() OVER (ORDER BY o_orderpriority)::DOUBLE AS t FROM orders")
def time_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.numeric_time(tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority"), "o_orderpriority", "t").select("id", "t")


@query("SELECT p_partkey AS id, p_size::DOUBLE AS t FROM part")
def time_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("size"))
    return labels.numeric_time(own, "size", "t").select("id", "t")


_SPLIT = "sp AS (SELECT id, cluster::VARCHAR AS cluster, (CASE WHEN cluster < 5 THEN id % 2 * 8 + id % 3 ELSE id % 9 END)::DOUBLE AS time FROM points)"


_REFINED = f"""WITH {POINTS}, {_SPLIT}, g AS (SELECT time - lag(time) OVER (ORDER BY time) AS g FROM (SELECT DISTINCT time FROM sp)), step AS (SELECT coalesce(median(g), 1) AS step FROM g WHERE g > 0),
wide AS (SELECT cluster FROM sp GROUP BY 1 HAVING count(*) >= 6 AND quantile_cont(time, 0.75) - quantile_cont(time, 0.25) >= (SELECT step FROM step)),
cut AS (SELECT a.cluster, a.time AS cut, count(*) FILTER (b.time <= a.time) AS n1, count(*) AS n, sum(b.time) FILTER (b.time <= a.time) AS s1, sum(b.time) AS s, sum(b.time ** 2) AS q FROM (SELECT DISTINCT cluster, time FROM sp) a JOIN sp b USING (cluster) GROUP BY 1, 2 HAVING n1 < n),
sc AS (SELECT cluster, cut, s1 ** 2 / n1 + (s - s1) ** 2 / (n - n1) - s ** 2 / n AS between_ss, q - s ** 2 / n AS total, least(n1, n - n1) / n AS share, (s - s1) / (n - n1) - s1 / n1 AS gap FROM cut),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(between_ss, 9) DESC, cut) = 1),
kept AS (SELECT cluster, cut FROM best JOIN wide USING (cluster) WHERE share >= 0.2 AND gap >= 1.1 * (SELECT step FROM step) AND between_ss / greatest(total, 1e-8) >= 0.3),
lab AS (SELECT id, time, CASE WHEN cut IS NULL THEN cluster ELSE cluster || CASE WHEN time <= cut THEN '_1' ELSE '_2' END END AS label FROM sp LEFT JOIN kept USING (cluster)),
nm AS (SELECT label, 'C' || row_number() OVER (ORDER BY median(time), label) AS cluster FROM lab GROUP BY label) SELECT id, cluster FROM lab JOIN nm USING (label)"""
# Only clusters whose parts are apart in the first five dimensions, too, are split.
_APART = _REFINED.replace("kept AS (SELECT cluster, cut", "timed AS (SELECT cluster, cut").replace(
    "\nlab AS",
    """
sides AS (SELECT cluster, sp.time <= cut AS early, v FROM timed JOIN sp USING (cluster) JOIN (SELECT id, v FROM points) USING (id)), dims AS (SELECT cluster, early, unnest(v[1:5]) AS x, unnest(range(1, 6)) AS dim FROM sides),
apart AS (SELECT cluster, dim, ((avg(x) FILTER (early) - avg(x) FILTER (NOT early)) / nullif(stddev_samp(x), 0)) ** 2 AS d FROM dims GROUP BY 1, 2),
kept AS (SELECT cluster, cut FROM timed WHERE cluster IN (SELECT cluster FROM apart GROUP BY 1 HAVING count(d) = count(*) AND sqrt(sum(d)) >= 0.55)),
lab AS""",
)


@query(_REFINED)
def refined_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.points(spark, sf_dir)
    time = F.when(F.col("cluster") < 5, F.col("id") % 2 * 8 + F.col("id") % 3).otherwise(F.col("id") % 9)
    return branching.refined_clusters(p.select("id", "cluster", time.alias("time")), min_size=6, min_separation=None)


@query(_APART)
def refined_clusters_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.points(spark, sf_dir)
    time = F.when(F.col("cluster") < 5, F.col("id") % 2 * 8 + F.col("id") % 3).otherwise(F.col("id") % 9)
    return branching.refined_clusters(p.select("id", "cluster", time.alias("time"), "v"), min_size=6)


@query()
def trajectory_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir).withColumn("time", F.col("cluster") % 4)
    return rounded(tata.run(points, clusters="cluster", expected_branches=2).cells.drop("time"))


@query()
def gene_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir)
    cells = points.select("id", "cluster", (F.col("id") % 997 / 996.0).alias("pt"))
    values = points.select("id", F.posexplode("v").alias("k", "value")).select("id", F.concat(F.lit("gene"), F.col("k").cast("string")).alias("gene_id"), "value")
    return rounded(trends.gene_trends(values, [f"gene{k}" for k in range(64)], cells, _shares(points)))


@query()
def integrated_mnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = integration.mutual_nearest(tables.points(spark, sf_dir).select("id", "v", "batch"))
    return rounded(by_dimension(got, "batch"))


@query()
def integrated_harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = integration.soft_clusters(tables.points(spark, sf_dir).select("id", "v", "batch"))
    return rounded(by_dimension(got, "batch"), 4)


@query()
def integration_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir).withColumn("cell_id", F.col("id").cast("string"))
    exp = experiment.Experiment(points.select("cell_id", "batch", "cluster"), None, {}, {"PCA": points.select("cell_id", F.col("v").alias("embedding")), "half": points.select("cell_id", F.slice("v", 1, 32).alias("embedding"))})
    return rounded(benchmark.benchmark(exp, "batch", "cluster")["scores"], 4)


@query(f"WITH {COUNTS} SELECT cell_id::VARCHAR AS cell_id, gene_id, value FROM counts")
def matrix_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts written as a Matrix Market folder of parts below the shared folder, and read back."""
    long = settled(tables.counts(spark, sf_dir).select(F.col("cell_id").cast("string").alias("cell_id"), "gene_id", "value"))
    root = shared_path(spark, "matrix")
    cells, genes = (long.select(c).distinct().orderBy(c) for c in ("cell_id", "gene_id"))
    cells.write.text(f"{root}/barcodes.tsv")
    genes.select(F.concat_ws("\t", "gene_id", "gene_id", F.lit("Gene Expression"))).write.text(f"{root}/features.tsv")
    rows = matrixmarket.read_table(spark, f"{root}/features.tsv").select(F.col("row").alias("i"), F.col("fields")[0].alias("gene_id"))
    cols = matrixmarket.read_table(spark, f"{root}/barcodes.tsv").select(F.col("row").alias("j"), F.col("fields")[0].alias("cell_id"))
    body = long.join(rows, "gene_id").join(cols, "cell_id").select(F.concat_ws(" ", "i", "j", "value").alias("value"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{genes.count()} {cells.count()} {long.count()}",)], "value string").coalesce(1)
    head.write.text(f"{root}/matrix.mtx")
    body.write.mode("append").text(f"{root}/matrix.mtx")
    return experiment.from_matrix_folder(spark, root).assays["counts"]


@query("SELECT p_partkey AS row, p_brand || CASE WHEN row_number() OVER w > 1 THEN '.' || (row_number() OVER w - 1) ELSE '' END AS name FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.unique_names(tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("name")), "name", "row").select("row", "name")


@query(
    f"""WITH {_LOG}, ids AS (SELECT cell_id, batch FROM ({"SELECT c_custkey AS cell_id, r_name AS batch FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"})),
half AS (SELECT cell_id, gene_id, logcount, CASE WHEN batch IN ('ASIA', 'AFRICA') THEN 'one' ELSE 'two' END AS part FROM logs JOIN ids USING (cell_id)),
both_parts AS (SELECT gene_id FROM half GROUP BY 1 HAVING count(DISTINCT part) = 2)
SELECT cell_id::VARCHAR AS cell_id, gene_id, round(logcount, 6) AS logcount FROM half JOIN both_parts USING (gene_id)"""
)
def merged_logcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, cells = features.log_normalise(tables.counts(spark, sf_dir)), tables.count_cells(spark, sf_dir)
    one = F.col("batch").isin("ASIA", "AFRICA")
    parts = [(name, cells.where(c)) for name, c in (("one", one), ("two", ~one))]
    own = [(name, c.select("cell_id"), logs.join(c.select("cell_id"), "cell_id", "left_semi").select("cell_id", "gene_id", "logcount")) for name, c in parts]
    return rounded(merge.merge_logcounts(own, [k for _, _, k in own]))
