"""Dispersion trends, the prior of the variances and ranks: plain versions, planted trends and outliers."""

import numpy as np
import pandas as pd
import pytest

from cytoplan.functions import ranking
from cytoplan.functions.statistics import f_tail, log_gamma, trigamma
from cytoplan.operators import dispersion as dp
from cytoplan.operators import expression

GENES, SAMPLES = 1200, 12


def true_dispersion(mean):
    return 0.04 + 1.5 / mean


@pytest.fixture(scope="module")
def null_fit(spark):
    r = np.random.default_rng(11)
    mean = np.exp(r.uniform(np.log(8), np.log(3000), GENES))
    phi = true_dispersion(mean)
    size = r.uniform(0.7, 1.4, SAMPLES)
    y = r.negative_binomial((1 / phi)[:, None], 1 / (1 + phi[:, None] * mean[:, None] * size))
    samples = spark.createDataFrame([(f"s{k:02d}", "ab"[k % 2]) for k in range(SAMPLES)], "pb_sample_id string, grp string")
    values = pd.DataFrame({"pb_sample_id": np.tile([f"s{k:02d}" for k in range(SAMPLES)], GENES), "gene_id": np.repeat([f"g{k:04d}" for k in range(GENES)], SAMPLES), "value": y.ravel().astype(float)})
    values = spark.createDataFrame(values[values.value > 0])
    table, fit = expression.pairwise_de(samples, values, "grp")
    return dict(zip((f"g{k:04d}" for k in range(GENES)), mean, strict=True)), table.toPandas(), fit


def test_planted_trend_is_found(null_fit):
    mean, _, fit = null_fit
    genes = fit.genes.select("gene_id", "logcpm", "dispersion", "gene_dispersion", "prior_df").toPandas().sort_values("logcpm")
    want = true_dispersion(genes.gene_id.map(mean).to_numpy())
    near = np.exp(pd.Series(np.log(want)).rolling(61, center=True).mean().to_numpy())  # of the genes that are seen at an abundance
    off = np.abs(genes.dispersion.to_numpy() / near - 1)[len(genes) // 20 : -len(genes) // 20]
    assert off.max() < 0.1 and off.mean() < 0.05
    # Genes of one trend are drawn to it, further than their own curves alone would lie.
    assert np.corrcoef(np.log(genes.gene_dispersion), np.log(want))[0, 1] > 0.9
    assert genes.prior_df.median() > 20


def test_false_positives_stay_at_their_share(null_fit):
    _, table, _ = null_fit
    assert 0.03 < (table.p < 0.05).mean() < 0.065 and (table.p < 0.005).mean() < 0.012
    assert table.significant.sum() <= 2


def plain_likelihood(y, x, offset, phi):
    beta, mu, _ = expression.fit_means(y, x, offset, phi)
    r, w = 1 / phi, mu / (1 + phi * mu)
    out = []
    for g in range(len(y)):
        own = log_gamma(y[g] + r) - log_gamma(np.full(len(y[g]), r)) - log_gamma(y[g] + 1) + y[g] * np.log(mu[g] / (mu[g] + r)) + r * np.log(r / (mu[g] + r))
        out.append(own.sum() - 0.5 * np.linalg.slogdet(x.T @ (w[g][:, None] * x))[1])
    return np.array(out)


def test_trend_is_the_plain_local_likelihood():
    r = np.random.default_rng(5)
    n, x = 80, np.repeat(np.eye(2), 4, 0)
    mean = np.exp(np.sort(r.uniform(3, 8, n)))
    phi = true_dispersion(mean)
    y = r.negative_binomial((1 / phi)[:, None], np.repeat((1 / (1 + phi * mean))[:, None], 8, 1)).astype(float)
    at, offset = np.log2(mean), np.zeros(8)
    curves = expression.profile_likelihood(y, x, offset, dp.GRID)
    for k in (0, 9, 20):
        assert np.allclose(curves[:, k], plain_likelihood(y, x, offset, float(np.exp(dp.GRID[k]))), rtol=1e-6)
    trend = dp.local_trend(at, np.ones(n), curves)
    span = 0.25 + 0.75 * np.sqrt(50 / n)
    cache = {}

    def exact(g, log_phi):
        key = (g, round(log_phi, 6))
        if key not in cache:
            cache[key] = plain_likelihood(y[g : g + 1], x, offset, float(np.exp(log_phi)))[0]
        return cache[key]

    for b in (0, 40, 79):
        far = np.abs(at - at[b])
        w = np.maximum(1 - (far / (np.sort(far)[int(np.ceil(span * n)) - 1] * 1.0001)) ** 3, 0) ** 3
        total = lambda level, slope, b=b, w=w: sum(w[g] * exact(g, np.clip(level + slope * (at[g] - at[b]), dp.GRID[0], dp.GRID[-1])) for g in np.flatnonzero(w))
        found = trend.log_dispersion[b]
        best = max((total(found + d, s), d) for d in (-0.2, -0.1, 0.0, 0.1, 0.2) for s in np.linspace(-1, 0.2, 13))
        assert abs(best[1]) <= 0.1


def test_moments_of_drawn_in_logs():
    r = np.random.default_rng(2)
    for d1, d2 in ((6, 10.0), (4, 50.0), (10, 1e7)):
        z = np.log(r.chisquare(d1, 400_000) / d1) - np.log(r.chisquare(min(d2, 1e5), 400_000) / min(d2, 1e5))
        z = np.clip(z, *np.quantile(z, [0.05, 0.9]))
        mean, variance = dp.log_f_moments(d1, d2)
        assert abs(mean - z.mean()) < 0.01 and abs(variance / z.var() - 1) < 0.02
    assert np.isclose(dp.log_f_moments(6, 10.0, (0.0, 0.0))[1], trigamma(3.0) + trigamma(5.0), rtol=1e-4)


def test_outliers_lose_degrees_of_freedom(spark):
    r = np.random.default_rng(8)
    n, free, d0 = 2000, 8, 12.0
    x = r.uniform(2, 12, n)
    s0 = np.exp(0.4 * np.sin(x / 2))
    v = s0 * (r.chisquare(free, n) / free) / (r.chisquare(d0, n) / d0)
    v[:10] = s0[:10] * 60
    genes = spark.createDataFrame(pd.DataFrame({"gene_id": np.arange(n), "logcpm": x, "variance": v}))
    for robust in (True, False):
        got, prior = dp.with_prior(genes, free, robust=robust, abundance_trend=True)
        got = got.toPandas().sort_values("gene_id")
        if robust:
            assert 8 < prior.df < 18 and prior.outlier_df < 3 and (got.prior_df[:10] < 4).all()
            assert (got.prior_df[10:] > 0.9 * prior.df).mean() > 0.95
            assert np.abs(np.log(got.prior_variance / s0)).mean() < 0.12
            f = got.variance / got.prior_variance
            assert np.isclose(f_tail(np.array([f.max()]), free, prior.outlier_df)[0], 0.5, atol=1e-6)
        else:
            assert got.prior_df.nunique() == 1
    flat, prior = dp.with_prior(genes, free, robust=False, abundance_trend=False)
    assert flat.select("prior_variance").distinct().count() == 1


def test_ranks_are_those_of_pandas(spark):
    r = np.random.default_rng(4)
    v = pd.Series(np.concatenate((r.normal(size=3000), np.repeat(0.5, 500), r.integers(0, 5, 500))))
    got = ranking.value_ranks(spark.createDataFrame(v.to_frame("v")).repartition(5), "v").toPandas().set_index("value").sort_index()
    want = v.value_counts().sort_index()
    assert (got.n == want).all() and (got.below == want.cumsum() - want).all()
    assert ranking.value_ranks(spark.createDataFrame([], "v double"), "v").count() == 0
