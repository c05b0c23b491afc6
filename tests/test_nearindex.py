"""The index of pivots against the exact neighbours."""

import numpy as np

from cytoplan.operators import nearindex, neighbors

SCHEMA = "id long, v array<double>"


def rows(df):
    return sorted((r.i, r.j, r["rank"], round(r.distance, 6)) for r in df.collect())


def cloud(n=600, copies=40):
    r = np.random.default_rng(5)
    centre = r.normal(0, 3, (12, 16))
    v = centre[r.integers(0, 12, n)] + r.normal(0, 1, (n, 16))
    v[:copies] = v[0]
    return [(k, x.tolist()) for k, x in enumerate(v)]


def test_few_pivots_are_exact(spark):
    points = spark.createDataFrame(cloud(), SCHEMA)
    want = rows(neighbors.knn(points, 5))
    assert rows(nearindex.knn_indexed(points, 5)) == want
    assert rows(nearindex.knn_indexed(points, 5, cell=60, probes=10)) == want  # all cells
    assert rows(nearindex.knn_indexed(points, 5, cell=60, probes=10, block=16)) == want  # crowded cells in blocks


def test_recall_where_cells_are_left_out(spark):
    points = spark.createDataFrame(cloud(1500), SCHEMA)
    want = {x[:2] for x in rows(neighbors.knn(points, 10))}
    got = {x[:2] for x in rows(nearindex.knn_indexed(points, 10, cell=20))}  # 75 pivots, probes by the sample
    assert 0.9 * len(want) <= len(want & got) < len(want)


def test_small_tables(spark):
    assert nearindex.knn_indexed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearindex.knn_indexed(spark.createDataFrame([(7, [1.0])], SCHEMA)).count() == 0
    assert rows(nearindex.knn_indexed(spark.createDataFrame([(7, [1.0]), (8, [3.0])], SCHEMA))) == [(7, 8, 1, 2.0), (8, 7, 1, 2.0)]
