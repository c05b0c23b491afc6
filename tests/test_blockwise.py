"""Neighbours by blocks and chunks against plain distances, and what they write."""

import os

import numpy as np
import pytest

from cytoplan.operators import blockwise, neighbors

SCHEMA = "id long, v array<double>"


def plain(ids, x, k, others=None):
    """Sorted (i, j, rank, distance) by brute force."""
    out = []
    jds, y = others or (ids, x)
    for i, v in zip(ids, x):
        d = np.round(np.sqrt(((y - v) ** 2).sum(1)), 9)
        best = sorted((a, int(j)) for a, j in zip(d.tolist(), jds) if others or j != i)[:k]
        out += [(int(i), j, r + 1, a) for r, (a, j) in enumerate(best)]
    return sorted(out)


def clouds():
    r = np.random.default_rng(8)
    v = r.normal(0, 3, (12, 8))[r.integers(0, 12, 700)] + r.normal(0, 1, (700, 8))
    v[:40] = v[0]
    ties = r.integers(0, 3, (300, 4)).astype(float)
    wide = v[:200] * 1e-3 + 1e7
    mixed = np.concatenate((v[:100], v[100:103] * 1e20, v[103:110] * 1e-12))
    return {"copies": v, "ties": ties, "shifted": wide, "mixed": mixed}


@pytest.mark.parametrize("name", ["copies", "ties", "shifted", "mixed"])
def test_all_pairs_in_chunks(spark, monkeypatch, name):
    x = clouds()[name]
    ids = np.random.default_rng(3).permutation(len(x)) - 50
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    want = plain(ids, x, 6)
    for chunk, tile in ((blockwise.CHUNK, 4096), (250 * x.shape[1], 32)):
        monkeypatch.setattr(blockwise, "CHUNK", chunk)
        monkeypatch.setattr(blockwise, "TILE", tile)
        assert sorted(tuple(r) for r in neighbors.knn(points, 6, block=64).collect()) == want
    half = points.where("pmod(id, 2) = 0")
    odd = ids % 2 == 1
    got = neighbors.knn_between(points.where("pmod(id, 2) = 1"), half, 5, block=64)
    assert sorted(tuple(r) for r in got.collect()) == [(i, j, d) for i, j, _, d in plain(ids[~odd], x[~odd], 5, (ids[odd], x[odd]))]


def test_what_is_written_grows_with_the_points(spark):
    """16 times the blocks: all pairs of blocks would be 256 times the bytes."""

    def written():
        root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(root) for f in files)

    r, sizes = np.random.default_rng(1), []
    for n in (64, 1024):
        points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r.normal(size=(n, 16)))], SCHEMA)
        before = written()
        assert neighbors.knn(points, 5, block=16).count() == 5 * n
        sizes.append(written() - before)
    assert sizes[1] < 32 * sizes[0]
