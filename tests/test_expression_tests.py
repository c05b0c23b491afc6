"""Differential expression: planted effects, and plain numbers for the functions behind."""

import numpy as np
import pytest

from cytoplan.functions import statistics as st
from cytoplan.operators import expression


def test_special_functions():
    assert np.allclose(st.log_gamma(np.array([0.5, 1, 5, 30.0])), [np.log(np.sqrt(np.pi)), 0, np.log(24), 71.257038967168])
    assert np.allclose(st.digamma(np.array([1.0])), -0.5772156649015329) and np.allclose(st.trigamma(1.0), np.pi**2 / 6)
    assert np.isclose(st.trigamma(st.inverse_trigamma(0.37)), 0.37)
    # F with 2 and n degrees of freedom has the tail (1 + 2 f / n) ** (-n / 2); F(1, n) is a squared t.
    f = np.array([0.1, 1.0, 4.0, 50.0])
    assert np.allclose(st.f_tail(f, 2, 8.0), (1 + 2 * f / 8) ** -4.0)
    assert np.allclose(st.f_tail(f, 1, 1.0), 1 - 2 / np.pi * np.arctan(np.sqrt(f)))


def test_natural_basis_is_straight_beyond_its_knots():
    knots = np.array([0.0, 1, 3, 4])
    far = st.natural_basis(np.array([4.0, 5, 6, -2, -1, 0]), knots)
    assert far.shape[1] == 3 and np.allclose(far[1] - far[0], far[2] - far[1]) and np.allclose(far[4] - far[3], far[5] - far[4])


@pytest.fixture(scope="module")
def bulk(spark):
    r = np.random.default_rng(1)
    samples, rows = [], []
    base = r.uniform(2, 7, 120)
    for k in range(18):
        group, time, size = k % 3, float(k % 6), r.uniform(0.6, 1.6)
        samples.append((f"pb_{k}", ["0", "2", "10"][group], time, "xy"[k // 9]))
        for g in range(120):
            mu = np.exp(base[g]) * size * (4.0 if g < 12 and group == 2 else 1.0)
            rows.append((f"pb_{k}", f"gene{g:03d}", float(r.negative_binomial(10, 10 / (10 + mu)))))
    for k in range(18):
        for g in range(8):
            rows.append((f"pb_{k}", f"wave{g}", float(r.poisson(60 * np.exp(1.2 * np.sin(k % 6))))))
    return spark.createDataFrame(samples, "pb_sample_id string, grp string, time double, side string"), spark.createDataFrame([x for x in rows if x[2]], "pb_sample_id string, gene_id string, value double")


def test_planted_groups_are_found(bulk):
    samples, values = bulk
    table, fit = expression.pairwise_de(samples, values, "grp", covariates=["side"])
    got = table.collect()
    assert {r.contrast for r in got} == {"2_vs_0", "10_vs_0"} and 0.02 < fit.dispersion < 0.3
    hits = {r.gene_id for r in got if r.contrast == "10_vs_0" and r.significant and r.gene_id.startswith("gene")}  # waves differ between the groups, too
    planted = {f"gene{g:03d}" for g in range(12)}
    assert len(hits & planted) >= 11 and len(hits - planted) <= 3
    assert all(1 < r.logfc < 3 for r in got if r.contrast == "10_vs_0" and r.gene_id in hits & planted)
    assert sum(r.significant for r in got if r.contrast == "2_vs_0" and r.gene_id.startswith("gene")) <= 2


def test_means_of_groups_are_the_plain_ones():
    r = np.random.default_rng(3)
    y, offset = r.poisson(20, (5, 6)).astype(float), np.zeros(6)
    x = np.repeat(np.eye(2), 3, 0)
    for phi in (0.0, 0.2):
        beta, mu, dev = expression.fit_means(y, x, offset, phi)
        assert np.allclose(np.exp(beta), y.reshape(5, 2, 3).mean(2), rtol=1e-5) and (dev > 0).all()


def test_waves_are_found_along_time(bulk):
    samples, values = bulk
    table, curves = expression.spline_de(samples, values, "time", df=3, grid=20)
    got = {r.gene_id: r for r in table.collect()}
    assert all(got[f"wave{g}"].significant for g in range(8)) and sum(r.significant for r in got.values()) <= 20
    assert curves.where("gene_id = 'wave0'").count() == 20 and curves.where("isnan(value)").isEmpty()
    means = samples.join(values, "pb_sample_id").selectExpr("'other' AS condition", "gene_id", "time", "value")
    both = expression.curves_with_fallback(curves, means.where("gene_id = 'wave0'"), 20)
    assert both.where("condition = 'other'").count() == 20


def test_unfit_inputs_are_refused(bulk):
    samples, values = bulk
    with pytest.raises(ValueError):
        expression.pairwise_de(samples.where("grp = '0'"), values, "grp")
    with pytest.raises(ValueError):
        expression.spline_de(samples.where("time < 2"), values, "time")
    with pytest.raises(ValueError):
        expression.complete_samples(samples.selectExpr("pb_sample_id", "NULL AS grp"), ["grp"])
