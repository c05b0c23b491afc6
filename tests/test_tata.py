"""Trajectories end to end, terminals, refinement, trends and the cell space."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplan.operators import branching, trends
from cytoplan.plans import tata


@pytest.fixture(scope="module")
def forked(spark):
    """A stem of three stages that forks into two arms of three stages each."""
    r = np.random.default_rng(2)
    rows, i = [], 0
    for stage in range(3):
        for _ in range(25):
            rows.append((i, f"s{stage}", float(stage), [stage * 1.5 + r.uniform(-0.9, 0.9), r.normal(0, 0.3), r.normal(0, 0.1)]))
            i += 1
    for arm, side in (("a", 1), ("b", -1)):
        for stage in range(3, 6):
            for _ in range(25):
                rows.append((i, f"{arm}{stage}", float(stage), [stage * 1.5 + (u := r.uniform(-0.9, 0.9)), side * (stage - 2 + u) * 1.5 + r.normal(0, 0.3), r.normal(0, 0.1)]))
                i += 1
    return spark.createDataFrame(rows, "id long, given string, time double, v array<double>")


def test_a_fork_has_two_ends(forked):
    got = tata.run(forked, clusters="given", k=10)
    assert got.root == "s0" and sorted(got.terminals) == ["a5", "b5"]
    cells = {r.id: r for r in got.cells.collect()}
    assert len(cells) == 225 and 0 <= min(c.pt for c in cells.values()) and max(c.pt for c in cells.values()) == 1
    assert np.corrcoef([c.time for c in cells.values()], [c.pt for c in cells.values()])[0, 1] > 0.95
    by = {r.cluster: r for r in got.branches.collect()}
    assert by["a4"].assignment == "a5" and by["b4"].assignment == "b5" and by["s0"].entropy > 0.5 > by["a5"].entropy
    assert abs(got.probabilities.groupBy("cluster").agg(F.sum("p").alias("s")).agg(F.max("s")).first()[0] - 1) < 1e-9
    assert {len(r.embedding) for r in got.space.collect()} == {5} or got.space.count() == 225
    one = tata.run(forked, clusters="given", k=10, expected_branches=1)
    assert len(one.terminals) == 1 and one.terminals[0] in ("a5", "b5")
    values = forked.select("id", F.lit("up").alias("gene_id"), (F.col("time") + 1).alias("value"))
    curves = trends.gene_trends(values, ["up", "absent"], got.cells, got.probabilities, grid=20)
    assert {r.gene_id for r in curves.select("gene_id").distinct().collect()} == {"up"}
    for branch in got.terminals:
        y = [r.value for r in curves.where(F.col("branch") == branch).orderBy("pseudotime").collect()]
        assert len(y) == 20 and y[-1] > y[0] + 2 and all(b > a - 0.3 for a, b in zip(y, y[1:], strict=False))
    assert [r.trend_cluster for r in trends.trend_clusters(curves).collect()] in ([1], [2])


def test_stages_that_are_not_asked_for(forked):
    got = tata.run(forked.drop("time"), use_time=False, clusters="given", k=10, do_pseudotime=False, do_branches=False)
    assert got.probabilities is None and got.space is None and got.edges.where("not ambiguous").isEmpty()
    for wrong in ({"k": 0}, {"root": "nowhere", "clusters": "given"}, {"do_pseudotime": False}, {"time_weight_mode": "no"}):
        with pytest.raises(ValueError):
            tata.run(forked, **wrong)


def test_routes(spark):
    edges = spark.createDataFrame([("root", "middle", 1.0), ("middle", "back", 1.0), ("back", "root", 10.0), ("reverse", "root", 1.0)], "from_cluster string, to_cluster string, weight double")
    routes = branching.Routes(edges, "root")
    assert routes.to("back") == ["root", "middle", "back"] and routes.to("reverse") == ["root", "reverse"] and routes.to("orphan") == []


def test_clusters_are_split_where_times_fall_apart(spark):
    r = np.random.default_rng(5)
    rows = [(i, "x", float(i % 2 * 4 + (i % 4 > 1)), [float(i % 2) * 3 + r.normal(), r.normal()]) for i in range(80)]
    rows += [(100 + i, "y", float(i % 6), [r.normal(), r.normal()]) for i in range(80)] + [(200 + i, "small", float(i % 2 * 9), [0.0, 0.0]) for i in range(10)]
    cells = spark.createDataFrame(rows, "id long, cluster string, time double, v array<double>")
    got = {x.id: x.cluster for x in branching.refined_clusters(cells).collect()}
    assert len({got[i] for i in range(0, 80, 2)}) == 1 and len({got[i] for i in range(1, 80, 2)}) == 1 and got[0] != got[1]
    assert len({got[i] for i in range(100, 180)}) == 1 and len({got[i] for i in range(200, 210)}) == 1
    assert got[0] == "C1" and sorted(set(got.values())) == ["C1", "C2", "C3", "C4"]
    missing = cells.withColumn("time", F.when(F.col("id") > 0, F.col("time")))
    assert {x.cluster for x in branching.refined_clusters(missing).collect()} == {"x", "y", "small"}


def test_local_curve_of_a_parabola_is_exact():
    x = np.linspace(0, 1, 41)
    got = trends.local_curve(x, 3 - x + 2 * x**2, np.ones(41), np.ones(41), np.linspace(-0.1, 1, 12), 0.4)
    want = np.clip(np.linspace(-0.1, 1, 12), 0, 1)
    assert np.allclose(got[1:], (3 - want + 2 * want**2)[1:]) and got[0] == got[1]
    few = trends.local_curve(np.array([0, 0.25, 0.5, 0.75, 1]), np.array([2.5, 6.5, 10.5, 14.5, 18.5]), np.full(5, 4.0), np.full(5, 4.0), np.linspace(0, 1, 10), 0.1)
    assert np.isfinite(few).all()


def test_scaling_of_odd_columns(spark):
    rows = [(1, [1.0, 5.0, float("nan")]), (2, [2.0, 5.0, 1.0]), (3, [6.0, 5.0, 3.0])]
    got, n = trends.safe_scaled(spark.createDataFrame(rows, "id int, x array<double>"), "x")
    x = np.array([r.x for r in got.orderBy("id").collect()])
    assert n == 2 and np.allclose(x.mean(0), 0) and np.allclose(x.std(0, ddof=1), 1) and np.isclose(x[0, 1], 0)
