"""Principal components, curves and contrasts against plain versions."""

import numpy as np
import pytest

from cytoplan.operators import differential, reduction


def test_pca_against_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 6))
    x[:, 5] = 2.0  # without spread
    rows = [(i, f"g{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    counts = spark.createDataFrame(rows, "cell_id long, gene_id string, logcount double")
    vectors = reduction.cell_vectors(spark.range(40).toDF("cell_id"), counts, counts.select("gene_id").distinct())
    scores, components = reduction.pca(vectors, 3)
    sd = x.std(0, ddof=1)
    z = np.where(sd > 1e-12, (x - x.mean(0)) / np.where(sd > 1e-12, sd, 1), 0)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    want = (u * s)[:, :3] * np.sign(v[:3][np.arange(3), abs(v[:3]).argmax(1)])
    got = np.array([r.embedding for r in scores.orderBy("cell_id").collect()])
    assert np.allclose(got, want, atol=1e-6)
    assert np.allclose([r.share for r in components.orderBy("component").collect()], (s**2 / (s**2).sum())[:3])


def test_missing_cell_is_zero(spark):
    counts = spark.createDataFrame([(1, "a", 2.0)], "cell_id long, gene_id string, logcount double")
    cells = spark.createDataFrame([(1,), (2,)], "cell_id long")
    got = reduction.cell_vectors(cells, counts, spark.createDataFrame([("a",), ("b",)], "gene_id string"))
    assert {r.cell_id: r.x for r in got.collect()} == {1: [2.0, 0.0], 2: [0.0, 0.0]}


def test_natural_spline():
    x, y = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 3.0, 0.0, 2.0])
    assert np.allclose(differential.natural_spline(x, y, x), y)
    ends = differential.natural_spline(x, y, np.array([0.0, 1e-3, 2e-3]))
    assert abs(ends[0] - 2 * ends[1] + ends[2]) < 1e-7  # straight at the end
    inner = [differential.natural_spline(x, y, np.array([1 - h, 1, 1 + h])) for h in (1e-4,)][0]
    assert abs((inner[1] - inner[0]) - (inner[2] - inner[1])) < 1e-6  # smooth at a knot
    assert np.allclose(differential.natural_spline(x, 2 * x + 1, np.linspace(0, 4, 9)), 2 * np.linspace(0, 4, 9) + 1)
    assert np.allclose(differential.natural_spline(x[:1], y[:1], x), 1.0) and np.allclose(differential.natural_spline(x[:2], y[:2], np.array([0.5])), 2.0)


def test_curves(spark):
    rows = [("c", "g", 0, 1.0), ("c", "g", 0, 3.0), ("c", "g", 2, 4.0), ("c", "h", 0, 5.0), ("d", "g", 1, 7.0), ("d", "g", None, 9.0)]
    got = differential.interpolated_curves(spark.createDataFrame(rows, "condition string, gene_id string, time int, value double"), 3)
    assert sorted((r.condition, r.gene_id, r.time, r.value) for r in got.collect()) == sorted(
        [("c", "g", 0.0, 2.0), ("c", "g", 1.0, 3.0), ("c", "g", 2.0, 4.0), ("c", "h", 0.0, 5.0), ("c", "h", 1.0, 5.0), ("c", "h", 2.0, 5.0), *[("d", "g", 1.0, 7.0)] * 3]
    )


def test_contrast_errors(spark):
    levels = spark.createDataFrame([(1, "a"), (2, "b")], "position int, level string")
    assert [tuple(r) for r in differential.contrast_pairs(levels, "reference", "b").collect()] == [("a", "b", "a_vs_b")]
    with pytest.raises(ValueError):
        differential.contrast_pairs(levels, "reference", "z")
    with pytest.raises(ValueError):
        differential.contrast_pairs(levels, "manual")


def test_same_samples_have_factor_one(spark):
    values = spark.createDataFrame([(s, f"g{i}", float(i * k)) for s, k in (("x", 1), ("y", 3)) for i in range(1, 9)], "pb_sample_id string, gene_id string, value double")
    assert all(abs(r.norm_factor - 1) < 1e-9 for r in differential.norm_factors(values).collect())
