"""Smoothing splines against dense solves."""

import numpy as np
import pytest

from cytoplan.functions import smoothing
from cytoplan.operators import plotdata, trends


def dense(x, y, w, penalty):
    """The minimiser by normal equations over the heights, second derivatives from the interpolating natural spline."""
    n = len(x)
    h = np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    smoother = np.linalg.inv(np.diag(w) + penalty * q @ np.linalg.solve(r, q.T)) @ np.diag(w)
    return smoother @ y, np.trace(smoother)


@pytest.mark.parametrize("n", [3, 4, 5, 30])
@pytest.mark.parametrize("penalty", [1e-8, 1e-3, 10.0])
def test_equal_to_a_dense_solve(n, penalty):
    r = np.random.default_rng(n)
    x, y, w = (np.arange(n) + 0.8 * r.random(n)) / n, r.normal(size=n), r.uniform(0.2, 3, n)
    heights, bends, trace = smoothing.fit(x, y, w, penalty)
    want, size = dense(x, y, w, penalty)
    assert np.allclose(heights, want, atol=1e-7) and np.isclose(trace, size, atol=1e-6)
    assert np.allclose(smoothing.evaluate(x, heights, bends, x), heights)
    mid = x[:-1] + np.diff(x) * 1e-7
    assert np.allclose(smoothing.evaluate(x, heights, bends, mid), heights[:-1], atol=1e-4)


def test_least_cross_validation_finds_the_wave():
    r = np.random.default_rng(1)
    x = np.linspace(2, 5, 80)
    y = np.sin(2 * x) + r.normal(0, 0.2, 80)
    got = smoothing.smoothing_spline(x, y)
    assert np.sqrt(((got - np.sin(2 * x)) ** 2).mean()) < 0.1
    scores = [(((y - h) ** 2).sum() / (1 - t / 80) ** 2, h) for h, t in (dense((x - 2) / 3, y, np.ones(80), 10.0**p) for p in np.linspace(-12, 3, 61))]
    assert np.allclose(got, min(scores, key=lambda s: s[0])[1], atol=1e-6)
    ahead = smoothing.smoothing_spline(x, y, at=np.array([5.0, 6.0, 7.0]))
    assert np.isclose(ahead[2] - ahead[1], ahead[1] - ahead[0])


def test_smoothing_parameter_orders_penalties():
    x, w = np.linspace(0, 1, 12), np.ones(12)
    a, b = (smoothing.penalty_of(x, w, s) for s in (0.4, 0.6))
    assert np.isclose(b / a, 256**0.6)
    # Of equal spacing h the squares of an inner spline sum to (1 + 16 + 1) / 36, its squared bends to 8 / 3 / h^3.
    assert np.isclose(smoothing.penalty_of(x, w, 1 / 3), 0.5 / (8 / 3 * 11**3), rtol=0.15)


def test_used_where_no_local_fit_is(spark, monkeypatch):
    monkeypatch.setattr(np.linalg, "matrix_rank", lambda *_: -1)
    x = np.linspace(0, 1, 9)
    got = trends.local_curve(x, x**2, np.ones(9), np.ones(9), np.linspace(0, 1, 5))
    monkeypatch.undo()
    assert np.allclose(got, smoothing.smoothing_spline(x, x**2, at=np.linspace(0, 1, 5), spar=0.6)) and 0.5 < got[-1] < 1.1
    nodes = spark.createDataFrame([(k, float(k), float(k % 2)) for k in range(6)], "cluster long, x double, y double")
    rows = plotdata.route_curves(nodes, {"a": [0, 1, 2, 3, 4, 5], "b": [0, 1]}, 11).orderBy("route", "step").collect()
    t = np.arange(6.0)
    assert np.allclose([r.y for r in rows[:11]], smoothing.smoothing_spline(t, t % 2, at=np.linspace(0, 5, 11), spar=0.5)) and len(rows) == 13
    monkeypatch.setattr(plotdata, "MAX_NODES", 3)
    with pytest.raises(ValueError):
        plotdata.route_curves(nodes, {"a": [0, 1]})
