"""Communities, pseudotime and absorption against plain versions."""

import math

import numpy as np
import pytest

from cytoplan.operators import communities, neighbors, pseudotime

EDGES = [  # from, to, weight, ambiguous, consistency
    (1, 2, 2.0, False, 0.8), (2, 3, 1.0, False, 0.5), (1, 3, 0.5, False, 1.0), (3, 4, 1.5, True, 0.1), (4, 3, 1.5, True, 0.1), (2, 5, 0.7, False, 0.9), (6, 5, 0.4, False, 0.6),
]
MEDIANS = {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0, 5: 5.0, 6: 4.0, 7: 2.5}


def graph(spark):
    return spark.createDataFrame(EDGES, "from_cluster long, to_cluster long, weight double, ambiguous boolean, consistency double")


def medians(spark):
    return spark.createDataFrame(list(MEDIANS.items()), "cluster long, median double")


def plain_pseudotime(root=1, step=1.0):
    order = [root, *sorted((c for c in MEDIANS if c != root), key=lambda c: (MEDIANS[c], c))]
    heaviest, pt = max(e[2] for e in EDGES), {root: 0.0}
    for c in order[1:]:
        ways = [
            pt[a] + max(0.35, (MEDIANS[b] - MEDIANS[a]) / step) * (1 + 0.35 * (1 - w / heaviest)) * (1.35 if amb else 1) * (1 + 0.25 * (1 - cons))
            for a, b, w, amb, cons in EDGES if b == c and a in pt and order.index(a) < order.index(c)
        ]
        if ways:
            pt[c] = max(ways)
    near = {}
    for a, b, w, *_ in EDGES:
        near[frozenset((a, b))] = near.get(frozenset((a, b)), 0) + w
    far = {c: math.inf for c in MEDIANS} | {root: 0.0}
    for _ in MEDIANS:
        for pair, w in near.items():
            for a, b in (tuple(pair), tuple(pair)[::-1]):
                far[b] = min(far[b], far[a] + 1 / w)
    known = [d for d in far.values() if d < math.inf]
    out = {}
    for c in MEDIANS:
        anchor = max(0.0, (MEDIANS[c] - MEDIANS[root]) / step)
        value = pt.get(c)
        if value is None and far[c] < math.inf:
            value = anchor + 0.75 + (far[c] - min(known)) / (max(known) - min(known)) * (max(pt.values()) + 0.75)
        out[c] = None if value is None else max(value, 0.85 * anchor)
    return out


@pytest.fixture(params=["driver", "joins"])
def way(request, monkeypatch):
    """Small graphs are settled by the driver, others by joins: both are tried."""
    if request.param == "joins":
        monkeypatch.setattr(pseudotime, "DRIVER_CELLS", 0)


def test_cluster_pseudotime(spark, way):
    root = spark.createDataFrame([(1,)], "cluster long")
    got = pseudotime.cluster_pseudotime(graph(spark), medians(spark), root, spark.createDataFrame([(1.0,)], "step double"))
    want = plain_pseudotime()
    assert want[7] is None and want[6] is not None
    assert {r.cluster: r.pt if r.pt is None else round(r.pt, 9) for r in got.collect()} == {c: p if p is None else round(p, 9) for c, p in want.items()}


def test_terminals_and_root(spark, way):
    pts = spark.createDataFrame([(c, p) for c, p in plain_pseudotime().items()], "cluster long, pt double")
    root = spark.createDataFrame([(1,)], "cluster long")
    assert {r.cluster for r in pseudotime.terminals(graph(spark), pts, root).collect()} == {3, 4, 5, 6, 7}
    loop = spark.createDataFrame([(1, 2, 1.0, False, 1.0), (2, 1, 1.0, False, 1.0)], graph(spark).schema)
    given = spark.createDataFrame([(1, 0.0), (2, 1.0)], "cluster long, pt double")
    assert [r.cluster for r in pseudotime.terminals(loop, given, root).collect()] == [2]
    cells = spark.createDataFrame([(c, t) for c in MEDIANS for t in ([0.0, 0.0] if c == 2 else [0.0, 1.0] if c == 1 else [2.0])], "cluster long, time double")
    assert pseudotime.choose_root(graph(spark), cells).first().cluster == 2


def test_absorption(spark, way):
    p = {(1, 2): 0.7, (1, 3): 0.3, (2, 1): 0.2, (2, 4): 0.5, (2, 2): 0.3, (3, 3): 1.0, (4, 4): 1.0}
    got = pseudotime.absorption(spark.createDataFrame([(a, b, x) for (a, b), x in p.items()], "from_cluster long, to_cluster long, p double"), spark.createDataFrame([(3,), (4,)], "cluster long"))
    q, r = np.array([[0, 0.7], [0.2, 0.3]]), np.array([[0.3, 0], [0, 0.5]])
    want = np.linalg.solve(np.eye(2) - q, r)
    found = {(x.cluster, x.terminal): x.p for x in got.collect()}
    assert np.allclose([[found[1, 3], found[1, 4]], [found[2, 3], found[2, 4]]], want, atol=1e-9)
    assert (found[3, 3], found[3, 4], found[4, 4]) == (1.0, 0.0, 1.0)


def test_communities(spark):
    pairs = [(g * 6 + i, g * 6 + j) for g in range(4) for i in range(6) for j in range(i)] + [(0, 6), (6, 12), (12, 18)]
    edges = spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs], "a long, b long, weight double").checkpoint()
    got = communities.communities(spark.range(24), edges)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [list(range(g * 6, g * 6 + 6)) for g in range(4)]
    assert neighbors.modularity(edges, got).first().modularity > 0.6
    alone = communities.communities(spark.range(3), edges.where("false"))
    assert {r.community for r in alone.collect()} == {0}
