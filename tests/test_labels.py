"""Labels as numbers and times, workflows and refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplan.functions import labels
from cytoplan.operators import features, merge, plotdata, pseudobulk, qc
from cytoplan.plans import workflow
from cytoplan.sources.experiment import Experiment


@pytest.mark.parametrize(
    ("given", "want"),
    [(["late", "early", "late"], [2, 1, 2]), (["10", "2", "0x3", "1e0"], [10, 2, 3, 1]), (["TRUE", "FALSE"], [2, 1]), (["2i", "1i"], [2, 1]), (["late", None, "early"], [2, None, 1]), (["10", None, "2"], [1, None, 2])],
)
def test_times_of_labels(spark, given, want):
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    assert [r.x for r in labels.numeric_time(df, "t", "x").orderBy("i").collect()] == want


def test_classes_of_genes(spark):
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    counts = spark.createDataFrame([("c1", "a", 3.0), ("c1", "b", 8.0), ("c1", "c", 1.0)], "cell_id string, gene_id string, value double")
    genes = spark.createDataFrame([("a", "gene"), ("b", "Ribosomal_Protein"), ("c", "rRNA")], "gene_id string, kind string")
    got = {r.cell_id: r for r in qc.qc_metrics_by_class(cells, counts, genes, "kind").collect()}
    assert (got["c1"].rrna_counts, got["c1"].ribo_counts, got["c1"].detected_features, got["c2"].total_counts) == (1, 8, 3, 0)
    with pytest.raises(ValueError):
        qc.qc_metrics_by_class(cells, counts, genes, "absent")


def test_chosen_features_and_prefixes(spark):
    genes = spark.createDataFrame([("a", False), ("b", False)], "gene_id string, is_hvg boolean")
    logs = spark.createDataFrame([(1, "b", 2.0)], "cell_id int, gene_id string, logcount double")
    assert [r.gene_id for r in features.select_features(logs, genes, 2, n=1).collect()] == ["b"]
    assert features.select_features(logs, genes, 2, "all").count() == 2
    cells = spark.createDataFrame([("c1", "s1", "b1"), ("c2", "s2", "b1")], "cell_id string, sample string, batch string")
    assert merge.prefix_of(cells, 2) == "b1" and merge.prefix_of(cells.select("cell_id"), 2) == "sample2"
    assert merge.merge_logcounts([("x", cells, None), ("y", cells, logs)], [logs, logs]) is None
    with pytest.raises(ValueError):
        pseudobulk.pseudobulk(cells.withColumn("k", F.lit(None).cast("string")), logs, ["k"])


def test_unintegrated_workflow(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(f"c{i}", f"g{k}", float(v)) for i in range(60) for k in range(12) if (v := r.poisson(9 if (k < 6) == (i < 30) else 1))]
    counts = spark.createDataFrame(rows, "cell_id string, gene_id string, value double")
    exp = Experiment(counts.select("cell_id").distinct(), counts.select("gene_id").distinct(), {"counts": counts})
    made = workflow.created(spark, exp, run_unintegrated=True, min_counts=1, unintegrated_options={"k": 3, "neighbours": 8, "resolution": 0.3, "umap": "picture"})
    assert made.meta["version"] and made.meta["unintegrated"]["umap"] == "picture" and made.meta["visualization"]["last_umap"]["input_reduction"] == "PCA"
    picture = made.reductions["picture"].collect()
    assert len(picture) == 60 and all(len(r.embedding) == 2 for r in picture)
    assert workflow.created(spark, exp, min_features=10).cells.count() < 60
    side = {}
    for x in made.cells.collect():
        side.setdefault(x.unintegrated_cluster, set()).add(int(x.cell_id[1:]) < 30)
    assert all(len(s) == 1 for s in side.values()) and made.reductions["PCA"].count() == 60
    assert workflow.with_pca(made, 3).reductions["PCA"] is made.reductions["PCA"]
    made.write(str(tmp_path / "parts"))
    again = workflow.from_parts(spark, str(tmp_path / "parts"))
    assert set(again.assays) == {"counts", "logcounts"} and set(again.reductions) == {"PCA", "picture"} and again.assays["counts"].count() == len(rows)
    with pytest.raises(FileNotFoundError):
        workflow.from_parts(spark, str(tmp_path))


def test_routes_are_smooth(spark):
    nodes = spark.createDataFrame([(c, float(i), float(i * i)) for i, c in enumerate("abcde")], "cluster string, x double, y double")
    got = plotdata.route_curves(nodes, {"long": list("abcde"), "short": ["a", "c"], "alone": ["a"]}, 9).collect()
    assert sorted({r.route for r in got}) == ["long", "short"] and sum(r.route == "long" for r in got) == 9 and sum(r.route == "short" for r in got) == 2
