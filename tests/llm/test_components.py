"""Components against a serial version, with hubs joined by a broadcast and without."""

import numpy as np
import pytest

from cytoplan.llm import common, components


def least_reachable(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot", [1000, 3])
def test_hubs_chains_and_random_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(components, "HOT_ROWS", hot)
    r = np.random.default_rng(4)
    edges = [(50, k) for k in range(51, 90)] + [(k, k + 1) for k in range(100, 130)] + [(95, 50), (129, 131)]
    edges += [tuple(int(x) for x in r.integers(200, 400, 2)) for _ in range(120)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    want = least_reachable([e for e in edges if e[0] != e[1]])
    assert {x.vertex: x.root for x in got.collect()} == {x: y for x, y in want.items() if x != y}


def test_a_round_writes_two_tables(spark, monkeypatch):
    """Files are what small rounds cost: a star is settled by one round, which no further one confirms."""
    tables = []
    monkeypatch.setattr(components, "written", lambda df, name: tables.append(name) or common.written(df, name))
    got = components.components(spark.createDataFrame([(1, k) for k in range(2, 50)], "a long, b long"))
    assert {x.vertex: x.root for x in got.collect()} == dict.fromkeys(range(2, 50), 1)
    assert tables == ["edges", "large", "stars"]
