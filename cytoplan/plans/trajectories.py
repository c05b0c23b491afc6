"""Queries on cluster graphs, times, scores and neighbour searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplan.functions.settle import settled
from cytoplan.operators import communities, metrics, neighbors, pseudotime, timescores, trajectory, walktrap
from cytoplan.plans.registry import _TIMES, KNN, POINTS, _nn, _timed, query, rounded
from cytoplan.sources import tables

_WEIGHTS = f"""{KNN}, {_TIMES}, e AS (SELECT least(p.cluster, q.cluster) AS f, greatest(p.cluster, q.cluster) AS t, CASE WHEN p.cluster > q.cluster THEN p.time - q.time ELSE q.time - p.time END AS d
  FROM edges JOIN times p ON a = p.id JOIN times q ON b = q.id WHERE p.cluster <> q.cluster AND p.time IS NOT NULL AND q.time IS NOT NULL),
fl AS (SELECT f, t, count(*) AS n, avg(sign(d)) AS flow, median(d) AS md FROM e GROUP BY 1, 2), m AS (SELECT cluster, median(time) AS m, count(*) AS size FROM times GROUP BY 1), l AS (SELECT DISTINCT cluster AS c FROM points),
sh AS (SELECT cluster, time, count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS p FROM times WHERE time IS NOT NULL GROUP BY 1, 2),
ov AS (SELECT a.cluster AS f, b.cluster AS t, sum(least(a.p, b.p)) AS o FROM sh a JOIN sh b USING (time) WHERE a.cluster < b.cluster GROUP BY 1, 2),
st AS (SELECT coalesce(median(g) FILTER (g > 0), 1) AS step FROM (SELECT time - lag(time) OVER (ORDER BY time) AS g FROM (SELECT DISTINCT time FROM times WHERE time IS NOT NULL))),
w0 AS (SELECT a.c AS f, b.c AS t, y.m - x.m AS gap, coalesce(o, 0) AS overlap, n, flow, md, abs(y.m - x.m) / step AS s FROM l a JOIN l b ON a.c < b.c JOIN m x ON x.cluster = a.c JOIN m y ON y.cluster = b.c CROSS JOIN st
  LEFT JOIN ov ON ov.f = a.c AND ov.t = b.c LEFT JOIN fl ON fl.f = a.c AND fl.t = b.c),
w1 AS (SELECT *, CASE WHEN n IS NULL THEN 1 ELSE 1 / (1 + greatest(s - 2, 0) / 2) END AS jump FROM w0),
w2 AS (SELECT *, CASE WHEN n IS NULL THEN 0 ELSE least(1, (0.6 * greatest(abs(flow), least(1, s / 2)) + 0.25 * (1 - 2 / (exp(2 * s) + 1)) + 0.15 * (1 - overlap)) * jump) END AS consistency FROM w1),
tw AS (SELECT *, CASE WHEN n IS NULL THEN 0 ELSE sign(CASE WHEN abs(flow) > 1e-8 THEN flow ELSE gap END) * consistency END AS signed FROM w2)"""
_GRAPH = f"""{_WEIGHTS}, pe AS (SELECT p.cluster AS ca, q.cluster AS cb FROM edges JOIN points p ON a = p.id JOIN points q ON b = q.id), ob AS (SELECT least(ca, cb) AS f, greatest(ca, cb) AS t, count(*) AS observed FROM pe WHERE ca <> cb GROUP BY ALL),
dg AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM pe UNION ALL SELECT cb FROM pe) GROUP BY 1), g0 AS (SELECT f, t, signed, consistency, (signed + 1) / 2 AS time_weight, observed / (x.d * y.d / (SELECT sum(d) FROM dg) + 1e-8) AS topology_weight
  FROM ob JOIN tw USING (f, t) JOIN dg x ON x.c = f JOIN dg y ON y.c = t), g1 AS (SELECT *, topology_weight * time_weight AS weight FROM g0 WHERE topology_weight * time_weight >= 0.01),
graph AS (SELECT f AS s, t AS e, weight, topology_weight, time_weight, consistency, signed, abs(signed) <= 0.1 AS ambiguous FROM g1 WHERE signed >= -0.1
  UNION ALL SELECT t, f, weight, topology_weight, time_weight, consistency, signed, abs(signed) <= 0.1 FROM g1 WHERE signed <= 0.1)"""
_GIVEN = "pts AS (SELECT DISTINCT cluster, (cluster * 7 % 10) / 2.0 AS pt FROM points)"


def _given(points: DataFrame) -> DataFrame:
    return points.select("cluster").distinct().select("cluster", (F.col("cluster") * 7 % 10 / 2.0).alias("pt"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points, nn = _nn(spark, sf_dir)
    edges = neighbors.adjacency(nn)
    return points, settled(trajectory.cluster_edges(trajectory.topology_weights(edges, points), trajectory.time_weights(edges, _timed(points))))


@query(
    f"""WITH {_WEIGHTS} SELECT f AS from_cluster, t AS to_cluster, coalesce(n, 0) AS n_time_edges, round(coalesce(flow, 0), 6) AS flow, round(coalesce(md, gap), 6) AS median_delta, round(gap, 6) AS gap, round(overlap, 6) AS overlap,
round(jump, 6) AS jump, round(consistency, 6) AS consistency, round(signed, 6) AS signed, round((signed + 1) / 2, 6) AS time_weight FROM tw"""
)
def time_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nn = _nn(spark, sf_dir)
    return rounded(trajectory.time_weights(neighbors.adjacency(nn), _timed(points)))


@query(
    f"""WITH {POINTS}, l AS (SELECT DISTINCT cluster AS c FROM points) SELECT a.c AS from_cluster, b.c AS to_cluster, 0::BIGINT AS n_time_edges, 0::DOUBLE AS flow, 0::DOUBLE AS median_delta, 0::DOUBLE AS gap, 1::DOUBLE AS overlap,
1::DOUBLE AS jump, 1::DOUBLE AS consistency, 0::DOUBLE AS signed, 0.5::DOUBLE AS time_weight FROM l a JOIN l b ON a.c < b.c"""
)
def neutral_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.neutral_times(tables.points(spark, sf_dir))


@query(
    f"""WITH {_GRAPH} SELECT s AS from_cluster, e AS to_cluster, round(weight, 6) AS weight, round(topology_weight, 6) AS topology_weight, round(time_weight, 6) AS time_weight, round(consistency, 6) AS consistency, round(signed, 6) AS signed, ambiguous FROM graph"""
)
def cluster_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_graph(spark, sf_dir)[1])


@query(
    f"""WITH {POINTS}, {_TIMES}, {_GIVEN}, g AS (SELECT min(pt - p) AS step FROM (SELECT pt, lag(pt) OVER (ORDER BY pt) AS p FROM pts) WHERE pt > p), r AS (SELECT id, cluster, time, rank() OVER (PARTITION BY cluster ORDER BY time) + (count(*) OVER (PARTITION BY cluster, time) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY cluster) AS n, count(DISTINCT time) OVER (PARTITION BY cluster) AS k FROM times)
SELECT id, cluster, round(pt + 0.5 * step * CASE WHEN k <= 1 THEN 0 WHEN time IS NOT NULL THEN (r - 1) / (n - 1) END, 6) AS pseudotime FROM r JOIN pts USING (cluster) CROSS JOIN g"""
)
def cell_pseudotime(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir)
    return rounded(trajectory.cell_pseudotime(_timed(points), _given(points)))


_STEPS = f"""{_GRAPH}, {_GIVEN}, w AS (SELECT s, e, weight * CASE WHEN y.pt - x.pt < -1e-8 THEN 0.15 ELSE 1 END AS w FROM graph JOIN pts x ON x.cluster = s JOIN pts y ON y.cluster = e WHERE s NOT IN (8, 9)),
p AS (SELECT s, e, sum(w) / sum(sum(w)) OVER (PARTITION BY s) AS p FROM w GROUP BY 1, 2)"""


@query(
    f"""WITH {_STEPS}
SELECT s AS from_cluster, e AS to_cluster, round(p, 6) AS p FROM p UNION ALL SELECT c, c, 1 FROM l WHERE c NOT IN (SELECT s FROM p)"""
)
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, edges = _graph(spark, sf_dir)
    return rounded(trajectory.transitions(edges, points.select("cluster").distinct(), _given(points), [8, 9]))


_PROB = "n AS (SELECT cluster, batch, count(*) AS n FROM points GROUP BY ALL), pr AS (SELECT c.cluster, b.batch, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY c.cluster) AS p FROM (SELECT DISTINCT cluster FROM points) c CROSS JOIN (SELECT DISTINCT batch FROM points) b LEFT JOIN n USING (cluster, batch))"


def _branches(points: DataFrame) -> DataFrame:
    grid = points.select("cluster").distinct().crossJoin(F.broadcast(points.select("batch").distinct()))
    n = grid.join(points.groupBy("cluster", "batch").agg(F.count(F.lit(1)).alias("n")), ["cluster", "batch"], "left").na.fill(0, ["n"])
    total = n.groupBy("cluster").agg(F.sum("n").alias("t"))
    return n.join(total, "cluster").select("cluster", F.concat(F.lit("branch_"), F.col("batch").cast("string")).alias("branch"), F.col("batch").alias("position"), (F.col("n") / F.col("t")).alias("p"))


@query(
    f"""WITH {POINTS}, {_PROB}, h AS (SELECT cluster, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(count(*)) AS h, max(p) AS m FROM pr GROUP BY 1), a AS (SELECT cluster, batch FROM pr QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY p DESC, batch) = 1)
SELECT cluster, round(h, 6) AS entropy, round(1 - h, 6) AS commitment, round(m, 6) AS max_probability, CASE WHEN m < 0.36 THEN 'ambiguous' ELSE 'branch_' || batch END AS assignment FROM h JOIN a USING (cluster)"""
)
def branch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trajectory.branch_table(_branches(tables.points(spark, sf_dir)), 0.36))


@query(f"WITH {POINTS}, {_PROB} SELECT id, points.cluster, p >= 0.33 AS selected FROM points JOIN pr ON pr.cluster = points.cluster AND pr.batch = 1")
def branch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir)
    probabilities = _branches(points)
    return trajectory.branch_cells(points.select("id", "cluster"), trajectory.branch_table(probabilities), probabilities, "branch_1", minimum=0.33)


def _scored(points: DataFrame) -> DataFrame:
    """Times, and the first coordinate, turned round, as a pseudotime with ties."""
    pt = points.select("id", "batch", (-F.round(F.col("v")[0], 1)).alias("pt"), F.abs(F.col("v")[1]).alias("activation"))
    return _timed(points).join(pt, "id")


_SCORED = f"{POINTS}, {_TIMES}, vals AS (SELECT t.id, t.time, t.cluster, p.batch, -round(p.v[1], 1) AS pt, abs(p.v[2]) AS activation FROM times t JOIN points p USING (id))"


@query(
    f"""WITH {_SCORED}, g AS (SELECT pt, time, rank() OVER (ORDER BY pt) + (count(*) OVER (PARTITION BY pt) - 1) / 2 AS rp, rank() OVER (ORDER BY time) + (count(*) OVER (PARTITION BY time) - 1) / 2 AS rt FROM vals WHERE time IS NOT NULL),
f AS (SELECT corr(rp, rt) AS r, min(pt) AS lo, max(pt) AS hi FROM g) SELECT id, round(CASE WHEN time IS NOT NULL THEN CASE WHEN r < 0 THEN 1 - (pt - lo) / (hi - lo) ELSE (pt - lo) / (hi - lo) END END, 6) AS oriented FROM vals, f"""
)
def oriented_pseudotime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timescores.orient(_scored(tables.points(spark, sf_dir))))


@query(
    f"""WITH {_SCORED}, g AS (SELECT pt AS x, time::DOUBLE AS y, count(*) AS n FROM vals WHERE time IS NOT NULL GROUP BY ALL), k AS (SELECT sum(sign(b.x - a.x) * sign(b.y - a.y) * a.n * b.n) AS net FROM g a JOIN g b ON a.x < b.x),
tx AS (SELECT sum(n * (n - 1) / 2) AS tx FROM (SELECT sum(n) AS n FROM g GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS ty FROM (SELECT sum(n) AS n FROM g GROUP BY y)), m AS (SELECT sum(n) * (sum(n) - 1) / 2 AS m FROM g)
SELECT round(net / sqrt((m - tx) * (m - ty)), 6) AS r FROM k, tx, ty, m"""
)
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timescores.correlation(_scored(tables.points(spark, sf_dir)), "pt", "time", "kendall"))


_AUC = f"""{_SCORED}, t AS (SELECT time, lead(time) OVER (ORDER BY time) AS later FROM (SELECT DISTINCT time FROM vals WHERE time IS NOT NULL)),
au AS (SELECT a.batch, a.time AS te, b.time AS tl, count(DISTINCT a.id) AS n1, count(DISTINCT b.id) AS n2, avg(CASE WHEN b.pt > a.pt THEN 1.0 WHEN b.pt = a.pt THEN 0.5 ELSE 0 END) AS auc FROM vals a JOIN t ON a.time = t.time JOIN vals b ON b.time = t.later AND b.batch = a.batch GROUP BY ALL)"""


@query(f'WITH {_AUC} SELECT batch AS "group", te::DOUBLE AS time_earlier, tl::DOUBLE AS time_later, n1 AS n_earlier, n2 AS n_later, round(auc, 6) AS auc, n1 * n2 AS weight FROM au WHERE n1 >= 3 AND n2 >= 3')
def adjacent_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timescores.adjacent_auc(_scored(tables.points(spark, sf_dir)), "batch", 3))


@query(f"WITH {_AUC} SELECT round(sum(auc * n1 * n2) / sum(n1 * n2), 6) AS adjacent_timepoint_auc, count(*) AS n_valid_comparisons FROM au WHERE n1 >= 3 AND n2 >= 3")
def adjacent_auc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timescores.auc_summary(timescores.adjacent_auc(_scored(tables.points(spark, sf_dir)), "batch", 3)))


_ONSET = f"{_SCORED}, on0 AS (SELECT b AS branch, CASE b WHEN 3 THEN NULL ELSE b * 10.0 END AS truth FROM range(4) r(b)), onset AS (SELECT branch, truth, median(pt) FILTER (activation >= 0.1) AS got, count(*) FILTER (activation >= 0.1) AS n FROM on0 LEFT JOIN vals ON batch = branch GROUP BY 1, 2)"


def _onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _scored(tables.points(spark, sf_dir)).withColumnRenamed("batch", "branch")
    truth = spark.range(4).select(F.col("id").alias("branch"), F.when(F.col("id") < 3, F.col("id") * 10.0).alias("true_onset"))
    return timescores.branch_onset(cells, truth, 0.1)


@query(f"WITH {_ONSET} SELECT branch, truth::DOUBLE AS true_onset, round(got, 6) AS inferred_onset, n AS n_committed_cells FROM onset")
def branch_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_onset(spark, sf_dir))


@query(
    f"""WITH {_ONSET}, v AS (SELECT truth, got, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2 AS rt, rank() OVER (ORDER BY got) + (count(*) OVER (PARTITION BY got) - 1) / 2 AS rg FROM onset WHERE truth IS NOT NULL AND got IS NOT NULL),
e AS (SELECT count(*) AS n, min(truth) AS t0, max(truth) AS t1, min(got) AS g0, max(got) AS g1, CASE WHEN min(got) < max(got) THEN corr(rt, rg) END AS rho FROM v), x AS (SELECT avg(abs((truth - t0) / (t1 - t0) - coalesce((got - g0) / nullif(g1 - g0, 0), 0))) AS mae FROM v, e),
k AS (SELECT sum(sign(b.truth - a.truth) * sign(b.got - a.got)) AS s, count(*) FILTER (a.truth <> b.truth) AS nt, count(*) FILTER (a.got <> b.got) AS ng FROM v a JOIN v b ON a.truth < b.truth), r AS (SELECT s / nullif(sqrt(nt * ng), 0) AS tau FROM k)
SELECT n AS n_branches_used, round(tau, 6) AS kendall_tau, round(rho, 6) AS spearman_rho, round(mae, 6) AS normalized_onset_mae, round((tau + 1) / 2, 6) AS order_score, round(1 - mae, 6) AS accuracy FROM e, x, r"""
)
def branch_onset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timescores.onset_summary(_onset(spark, sf_dir)))


_REACH = f"""{_GRAPH.replace("edges AS (", "edges AS MATERIALIZED (", 1)}, arcs AS MATERIALIZED (SELECT DISTINCT s, e FROM graph), reach AS (SELECT s, e FROM arcs UNION SELECT reach.s, arcs.e FROM reach JOIN arcs ON reach.e = arcs.s),
rp AS (SELECT x.cluster AS a, y.cluster AS b, y.m - x.m AS gap, CASE WHEN (x.cluster, y.cluster) NOT IN (SELECT s, e FROM reach) THEN 0 WHEN (y.cluster, x.cluster) IN (SELECT s, e FROM reach) THEN 0.5 ELSE 1 END AS score, x.size * y.size AS w FROM m x JOIN m y ON x.cluster <> y.cluster AND y.m - x.m > 0)"""


def _reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, edges = _graph(spark, sf_dir)
    clusters = _timed(points).groupBy("cluster").agg(F.median("time").alias("median"), F.count(F.lit(1)).alias("n"))
    return timescores.reachability(edges, clusters)


@query(f"WITH RECURSIVE {_REACH} SELECT a AS earlier, b AS later, round(gap, 6) AS gap, score::DOUBLE AS score, w::DOUBLE AS weight FROM rp")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_reachability(spark, sf_dir))


@query(f"WITH RECURSIVE {_REACH} SELECT count(*) AS n_pairs, round(sum(score * w) / sum(w), 6) AS concordance FROM rp")
def reachability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timescores.reachability_summary(_reachability(spark, sf_dir)))


@query(
    f"""WITH {POINTS}, d AS (SELECT a.id, a.cluster AS own, b.cluster AS c, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM points a JOIN points b ON true GROUP BY ALL),
s AS (SELECT id, max(s / (n - 1)) FILTER (own = c AND n > 1) AS a, min(s / n) FILTER (own <> c) AS b FROM d GROUP BY 1), m AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS value FROM s)
SELECT round(value, 6) AS value, round((value + 1) / 2, 6) AS score FROM m"""
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.silhouette(tables.points(spark, sf_dir), "cluster"))


_METHODS = "scores AS (SELECT p_brand AS method, ['pcr_batch', 'ilisi', 'kbet_like', 'graph_connectivity', 'clisi', 'ari', 'nmi', 'silhouette'][p_partkey % 8 + 1] AS metric, CASE WHEN p_partkey % 5 > 0 THEN p_size / 50.0 END AS score FROM part)"


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(m) for m in ("pcr_batch", "ilisi", "kbet_like", "graph_connectivity", "clisi", "ari", "nmi", "silhouette")))
    part = tables.read(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("method"), names[(F.col("p_partkey") % 8).cast("int")].alias("metric"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") / 50.0).alias("score"))


@query(f"WITH {_METHODS}, m AS (SELECT method, avg(score) AS score FROM scores WHERE score IS NOT NULL GROUP BY 1) SELECT method, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, method) AS rank FROM m")
def method_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rank_methods(_methods(spark, sf_dir)))


@query(
    f"""WITH {_METHODS} SELECT method, round(avg(score) FILTER (metric IN ('pcr_batch', 'ilisi', 'kbet_like', 'graph_connectivity')), 6) AS batch_removal,
round(avg(score) FILTER (metric NOT IN ('pcr_batch', 'ilisi', 'kbet_like', 'graph_connectivity')), 6) AS bio_conservation FROM scores WHERE score IS NOT NULL GROUP BY 1"""
)
def method_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.tradeoff(metrics.category_scores(_methods(spark, sf_dir))))


def by_dimension(points: DataFrame, *more: str) -> DataFrame:
    """id, the other columns, dim (from 1) and value: a row for each coordinate."""
    return points.select("id", *more, F.posexplode("v").alias("k", "value")).select("id", *more, (F.col("k") + 1).cast("long").alias("dim"), "value")


_COSINE = f"{POINTS}, unit AS (SELECT id, batch, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-8)) AS v FROM points)"


@query(f"WITH {_COSINE} SELECT id, k AS dim, round(v[k], 6) AS value FROM unit, range(1, 65) r(k)")
def cosine_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = neighbors.cosine_normalised(tables.points(spark, sf_dir).select("id", "v"))
    return rounded(by_dimension(unit))


@query(
    f"""WITH {_COSINE}, d AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.v, b.v), 9) AS d FROM unit a JOIN unit b ON a.batch = 0 AND b.batch = 1),
x AS (SELECT i, j FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 20), y AS (SELECT i, j FROM d QUALIFY row_number() OVER (PARTITION BY j ORDER BY d, i) <= 20) SELECT i, j FROM x JOIN y USING (i, j)"""
)
def mutual_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = neighbors.cosine_normalised(tables.points(spark, sf_dir).select("id", "v", "batch"))
    a, b = unit.where("batch = 0"), unit.where("batch = 1")
    return neighbors.mutual_pairs(unit, neighbors.knn_between(b, a, 20), neighbors.knn_between(a, b, 20))


@query()
def louvain_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nn = _nn(spark, sf_dir)
    return communities.communities(points.select("id"), neighbors.weighted_graph(nn))


@query()
def leiden_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nn = _nn(spark, sf_dir)
    return communities.communities(points.select("id"), neighbors.weighted_graph(nn), method="leiden")


@query()
def walktrap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nn = _nn(spark, sf_dir)
    return walktrap.walktrap(points.select("id"), neighbors.weighted_graph(nn))


@query()
def cluster_pseudotime(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, edges = _graph(spark, sf_dir)
    cells, edges = _timed(points), settled(edges)
    medians = cells.groupBy("cluster").agg(F.median("time").alias("median"))
    return rounded(pseudotime.cluster_pseudotime(edges, medians, settled(pseudotime.choose_root(edges, cells)), trajectory.typical_step(cells)))


# 4,096 steps, by squaring twelve times.
_SQUARES = ", ".join(f"m{k + 1} AS MATERIALIZED (SELECT a.s, b.e, sum(a.p * b.p) AS p FROM m{k} a JOIN m{k} b ON a.e = b.s GROUP BY 1, 2)" for k in range(12))


@query(
    f"""WITH {_STEPS}, m0 AS MATERIALIZED (SELECT s, e, p FROM p UNION ALL SELECT c, c, 1 FROM l WHERE c NOT IN (SELECT s FROM p)), {_SQUARES},
full_shares AS (SELECT l.c AS cluster, t.t AS terminal, coalesce(m12.p, 0) AS p FROM l CROSS JOIN (SELECT unnest([8, 9])::BIGINT AS t) t LEFT JOIN m12 ON m12.s = l.c AND m12.e = t.t)
SELECT cluster, terminal, round(p / greatest(sum(p) OVER (PARTITION BY cluster), 1e-12), 6) AS p FROM full_shares"""
)
def branch_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, edges = _graph(spark, sf_dir)
    steps = trajectory.transitions(edges, points.select("cluster").distinct(), _given(points), [8, 9])
    return rounded(pseudotime.absorption(steps, spark.createDataFrame([(8,), (9,)], "cluster long")))
