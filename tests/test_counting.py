"""Kendall's tau by merging and the trend of variances, against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from cytoplan.operators import features, timescores


def plain_tau(x, y):
    s = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    tx, ty = ((a[:, None] != a[None]).sum() for a in (x, y))
    return s.sum() / np.sqrt(float(tx) * float(ty)) if tx and ty else None


@pytest.mark.parametrize("kind", ["distinct", "ties", "hot", "constant", "few"])
def test_tau(spark, kind, monkeypatch):
    monkeypatch.setattr(timescores, "RANGES", 8)
    r = np.random.default_rng(len(kind))
    n = 3 if kind == "few" else 900
    x, y = r.normal(size=n), r.normal(size=n)
    y += 0.5 * x
    if kind == "ties":
        x, y = np.round(x, 1), np.round(y * 2)
    if kind == "hot":
        x[:400], y[300:600] = 0.25, -0.5
    if kind == "constant":
        x[:] = 1
    got = timescores.correlation(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(3), "x", "y", "kendall").first().r
    want = plain_tau(x, y)
    assert got is None if want is None else np.isclose(got, want, atol=1e-12)


def test_tau_of_many_points(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("cast(id as double) AS x", f"cast(pmod(id * 7919, {n}) as double) AS y")
    x = np.arange(n)
    y = x * 7919 % n
    # Counted by a tree over the places.
    tree, rising = [0] * (n + 1), 0
    for v in y.tolist():
        k = v
        while k > 0:
            rising += tree[k]
            k &= k - 1
        k = v + 1
        while k <= n:
            tree[k] += 1
            k += k & -k
    pairs = n * (n - 1) // 2
    assert np.isclose(timescores.correlation(rows, "x", "y", "kendall").first().r, (2 * rising - pairs) / pairs, atol=1e-12)


def test_rising_by_trying_all():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 40):
        a, b, w = r.integers(0, 6, n), r.integers(0, 6, n), r.integers(1, 5, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if a[i] < a[j] and b[i] < b[j])
        assert timescores.rising(a, b, w) == want


def plain_lowess(x, y, span, rounds=3):
    n, firm = len(x), np.ones(len(x))
    for _ in range(rounds + 1):
        fit = []
        for own in x:
            d = np.abs(x - own)
            h = np.sort(d)[int(np.ceil(span * n)) - 1]
            w = firm * np.where(d < h * 1.0000001, (1 - (d / (h * 1.0000001)) ** 3) ** 3, 0)
            a = np.stack([np.ones(n), x - own], 1) * np.sqrt(w)[:, None]
            fit.append(np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][0])
        off = np.abs(y - np.array(fit))
        s = np.sort(off)[int(np.ceil(n / 2)) - 1]
        firm = np.maximum(np.where(off < 6 * s, (1 - (off / (6 * s)) ** 2) ** 2, 0), 1e-6)
    return np.array(fit)


def test_variance_trend_is_the_plain_fit(spark):
    r = np.random.default_rng(3)
    mean = np.sort(r.uniform(0.01, 3, 120))
    variance = mean * r.gamma(20, 1 / 20, 120) + 0.3 * mean**2
    variance[[30, 70, 100]] *= 4
    frame = spark.createDataFrame(pd.DataFrame({"gene_id": [f"g{k:03d}" for k in range(120)], "mean": mean, "variance": variance})).repartition(4)
    got = features.variance_residuals(frame).orderBy("gene_id").toPandas()
    used = mean >= 0.1
    fit = np.maximum(plain_lowess(mean[used], variance[used] ** 0.25, 0.3), 0) ** 4
    want = np.where(used, np.interp(mean, mean[used], fit ** 0.25) ** 4, fit[0] ** 1.0 * mean / 0.1)
    assert np.allclose(got.fitted[used], want[used], rtol=1e-6) and np.allclose(got.residual, got.variance - got.fitted)
    low = ~used
    assert np.allclose(got.fitted[low], fit[0] * mean[low] / 0.1)
    assert set(got.nlargest(3, "residual").gene_id) <= {"g030", "g070", "g100"} | set(got.nlargest(6, "residual").gene_id)
    assert {"g070", "g100"} <= set(got.nlargest(4, "residual").gene_id)


def test_genes_are_chosen_by_residual(spark):
    cells = 50
    rows = [(c, "steady", 2.0 + (c % 2) * 0.1) for c in range(cells)] + [(c, f"plain{g}", 0.5 + g * 0.1 + (c * 7 % 10) * (0.05 + g * 0.01)) for c in range(cells) for g in range(20)]
    rows += [(c, "lively", 3.0 * (c % 10 == 0)) for c in range(cells) if c % 10 == 0]
    logs = spark.createDataFrame(rows, "cell_id long, gene_id string, logcount double")
    genes = logs.select("gene_id").distinct()
    assert features.select_features(logs, genes, cells, n=1, by="residual").first().gene_id == "lively"
    with pytest.raises(ValueError):
        features.select_features(logs, genes, cells, by="luck")
    assert features.variance_residuals(spark.createDataFrame([("a", 0.0, 0.0)], "gene_id string, mean double, variance double")).first().residual == 0
