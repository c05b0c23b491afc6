"""Written steps, their deletion, and broadcasts behind a check of size."""

import os

import pytest

from cytoplan.functions import settle
from cytoplan.operators import communities


def folder(spark):
    return spark.conf.get("spark.checkpoint.dir").removeprefix("file://")


def test_forgotten_tables_are_deleted(spark):
    first, second = settle.settled(spark.range(5)), settle.settled(spark.range(7))
    at = first._settled_at.removeprefix("file://")
    assert os.path.isdir(at)
    settle.forget(first, None, spark.range(3), first)
    assert not os.path.exists(at) and second.count() == 7


def test_rounds_leave_few_tables(spark):
    edges = settle.settled(spark.createDataFrame([(k, k + 1, 1.0) for k in range(20)], "a long, b long, weight double"))
    before = set(os.listdir(folder(spark)))
    found = communities.communities(spark.range(21), edges, driver_edges=0)
    made = set(os.listdir(folder(spark))) - before
    assert found.count() == 21 and len(made) < 25  # without deletion about two for each of dozens of rounds


def test_only_small_tables_are_broadcast(spark, monkeypatch):
    assert settle.small(spark.range(4)).count() == 4
    monkeypatch.setattr(settle, "BROADCAST_ROWS", 3)
    with pytest.raises(ValueError):
        settle.small(spark.range(4), "levels")
