"""Every query of the library against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from cytoplan.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def plain(row):
    return tuple(None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) else str(x) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted((plain(r) for r in got.select(columns).collect()), key=str)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert mine == sorted((plain(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=str)


def test_empty_cell_has_zeros(spark):
    from cytoplan.operators import qc

    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    counts = spark.createDataFrame([("c1", "rrsA", 4.0), ("c1", "rrlB", 6.0), ("c1", "rplC", 2.0), ("c1", "rpsD", 8.0), ("c1", "geneY", 5.0)], "cell_id string, gene_id string, value double")
    got = {r.cell_id: r for r in qc.qc_metrics(cells, counts).collect()}
    assert (got["c1"].total_counts, got["c1"].detected_features, got["c1"].rrna_counts, got["c1"].rrna_fraction, got["c1"].pct_rrna, got["c1"].ribo_counts) == (25, 5, 10, 0.4, 40, 10)
    assert (got["c2"].total_counts, got["c2"].rrna_fraction) == (0, 0)


def test_variance_counts_zeros(spark):
    from cytoplan.operators import features

    rows = [(c, "constant", 2.0) for c in range(4)] + [(3, "variable", 8.0), (1, "medium", 2.0), (3, "medium", 2.0)]
    got = features.gene_variance(spark.createDataFrame(rows, "cell_id int, gene_id string, logcount double"), 4)
    assert {r.gene_id: r.variance for r in got.collect()} == {"constant": 0, "variable": 12, "medium": 1}
    assert [r.gene_id for r in features.top_features(got, 2).orderBy("rank").collect()] == ["variable", "medium"]
