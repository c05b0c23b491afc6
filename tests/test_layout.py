"""Layouts of embeddings: plain bandwidths and unions, trust in the neighbours, blocks."""

import numpy as np
import pytest

from cytoplan.operators import layout


@pytest.fixture(scope="module")
def cells(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=(20, 12)) * 2
    v = centre[np.arange(320) % 20] + r.normal(size=(320, 12)) * 0.6
    z = v - v.mean(0)
    d = np.linalg.svd(z, full_matrices=False)[2]
    points = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "id long, v array<double>").checkpoint()
    start = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z @ d[:2].T)], "id long, x double, y double").checkpoint()
    return v, points, start


def plain_trust(v, y, k):
    n = len(v)
    dv, dy = (np.round(np.sqrt(((a[:, None] - a[None]) ** 2).sum(2)), 9) + np.diag([np.inf] * n) for a in (v, y))
    lost = 0
    for i in range(n):
        rank = {j: r for r, j in enumerate(np.argsort(dv[i], kind="stable"), 1)}
        lost += sum(max(0, rank[j] - k) for j in np.argsort(dy[i], kind="stable")[:k])
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


def test_trust_above_that_of_components(spark, cells, monkeypatch):
    v, points, start = cells
    base = layout.trustworthiness(points, start)
    assert np.isclose(base, plain_trust(v, np.array([(r.x, r.y) for r in start.orderBy("id").collect()]), 15), atol=1e-6)
    got = layout.umap(points, start, k=15, cosine=False, rounds=8).checkpoint()
    assert got.count() == 320 and got.where("isnan(x) or isnan(y)").isEmpty()
    trust = layout.trustworthiness(points, got)
    print("trustworthiness", trust, "components", base)
    assert trust > base + 0.02 and trust > 0.9
    monkeypatch.setattr(layout, "BLOCK", 100)  # several tasks
    apart = layout.umap(points, start, k=15, cosine=True, rounds=8)
    assert layout.trustworthiness(points, apart) > base


def test_bandwidths_are_those_of_a_plain_search():
    d = np.sort(np.random.default_rng(3).random((20, 10)), 1)
    d[0], d[1, :2] = 0.0, 0.0
    near, width = layout.bandwidths(d)
    for row, lo, s in zip(d[1:], near[1:], width[1:], strict=True):
        assert lo == row[row > 0].min()
        assert np.isclose(np.exp(-np.maximum(row - lo, 0) / s).sum(), np.log2(11), atol=1e-4)
    assert np.isfinite(width).all() and (width > 0).all()
    a, b = layout.curve(1.0, 0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01  # known values


def test_union_of_memberships(spark):
    nn = [(0, 1, 1.0), (0, 2, 2.0), (1, 0, 1.0), (1, 2, 1.5), (2, 1, 1.5), (2, 0, 2.0), (3, 0, 3.0), (3, 1, 3.5)]
    got = {(r.i, r.j): r.w for r in layout.memberships(spark.createDataFrame(nn, "i long, j long, distance double"), 2).collect()}
    assert all(np.isclose(got[j, i], w) for (i, j), w in got.items())
    near, width = layout.bandwidths(np.array([[1.0, 2.0], [1.0, 1.5], [1.5, 2.0], [3.0, 3.5]]))
    one = {(i, j): np.exp(-max(0, d - near[i]) / width[i]) for i, j, d in nn}
    for (i, j), w in got.items():
        p, q = one.get((i, j), 0.0), one.get((j, i), 0.0)
        assert np.isclose(w, p + q - p * q)


def test_few_points(spark):
    with pytest.raises(ValueError):
        layout.umap(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, v array<double>"), spark.createDataFrame([], "id long, x double, y double"))
    three = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(3)], "id long, v array<double>")
    assert layout.umap(three, spark.createDataFrame([(0, 0.0, 1.0)], "id long, x double, y double"), rounds=2).count() == 3
