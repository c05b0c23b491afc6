"""Matrix Market folders, names, alignment and merging of small objects."""

import gzip

import pytest
from pyspark.sql import functions as F

from cytoplan.operators import ingest, merge
from cytoplan.sources import experiment, matrixmarket

TOY = {"rrsA": [5, 0, 1, 0, 8, 1], "geneB": [0, 3, 0, 2, 1, 0], "rplC": [9, 8, 7, 0, 0, 0], "geneD": [1, 1, 1, 9, 8, 7]}


def folder(path, packed=False):
    root = path / "filtered_feature_bc_matrix"
    root.mkdir()
    entries = [(g + 1, c + 1, v) for g, row in enumerate(TOY.values()) for c, v in enumerate(row) if v]
    files = {
        "matrix.mtx": "%%MatrixMarket matrix coordinate integer general\n% made here\n" + f"4 6 {len(entries)}\n" + "".join(f"{g} {c} {v}\n" for g, c, v in entries),
        "barcodes.tsv": "".join(f"cell{i}\n" for i in range(1, 7)),
        "features.tsv": "".join(f"id{i}\t{g}\tGene Expression\n" for i, g in enumerate(TOY)),
    }
    for name, text in files.items():
        if packed:
            (root / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (root / name).write_text(text)
    return str(path)


@pytest.mark.parametrize("packed", [False, True])
def test_matrix_folder(spark, tmp_path, packed):
    made = experiment.create(spark, folder(tmp_path, packed), values={"sample": "s1", "batch": None})
    got = {(r.gene_id, r.cell_id): r.value for r in made.assays["counts"].collect()}
    assert got == {(g, f"cell{c + 1}"): v for g, row in TOY.items() for c, v in enumerate(row) if v}
    assert {tuple(r) for r in made.cells.collect()} == {(f"cell{i}", "s1") for i in range(1, 7)} and made.meta["source"] == str(tmp_path)
    assert {r.ID for r in made.genes.collect()} == {f"id{i}" for i in range(4)}
    made.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/assays/counts")).count() == len(got)


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    (tmp_path / "barcodes.tsv").write_text("".join(f"b{i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = matrixmarket.numbered_lines(spark, str(tmp_path / "barcodes.tsv"))
        assert rows.select("value", "row").where(F.concat(F.lit("b"), (F.col("row") - 1).cast("string")) == F.col("value")).count() == 20000
        assert rows.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_folder_and_wrong_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        matrixmarket.locate(spark, str(tmp_path))
    with pytest.raises(TypeError):
        experiment.create(spark, 3)


def test_wide_table(spark):
    wide = spark.createDataFrame([(g, *map(float, row)) for g, row in TOY.items()], "gene string, " + ", ".join(f"cell{i} double" for i in range(1, 7)))
    made = experiment.create(spark, wide, gene="gene")
    assert made.cells.count() == 6 and made.assays["counts"].count() == 16


def test_unique_names(spark):
    names = ["a", "a", "a.1", "b", "a", "a.1", None, "c"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r.name for r in ingest.unique_names(df, "name", "i").orderBy("i").collect()]
    assert got == ["a", "a.2", "a.1", "b", "a.3", "a.1.1", None, "c"]


def test_feature_names(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, "g", "y"), (3, None, "z"), (4, "g", "w")], "row int, Symbol string, old string")
    got = ingest.feature_names(df, "row", current="old").orderBy("row").select("feature", "feature_id").collect()
    assert [tuple(r) for r in got] == [("x", "x"), ("g", "y"), ("z", "z"), ("g.1", "w")]
    bare = spark.createDataFrame([(1, None), (2, "")], "row int, Symbol string")
    assert [r.feature for r in ingest.feature_names(bare, "row").orderBy("row").collect()] == ["feature_1", "feature_2"]


def test_alignment(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    good = spark.createDataFrame([("b", 2), ("a", 1)], "cell_id string, x int")
    assert {tuple(r) for r in ingest.aligned(good, ids, "cell_id", "cells").collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(ValueError, match="lacks identifiers: b"):
        ingest.aligned(spark.createDataFrame([("a", 1), ("c", 2)], "cell_id string, x int"), ids, "cell_id", "cells")
    with pytest.raises(ValueError, match="1 rows, not 2"):
        ingest.aligned(good.limit(1), ids, "cell_id", "cells")
    with pytest.raises(ValueError, match="not found: when"):
        ingest.annotated(good, {"time": "when"}, {})


def test_merged_reductions(spark):
    cells = [spark.createDataFrame([(f"s{k}_c{i}", f"c{i}") for i in range(3)], "cell_id string, original_cell_id string") for k in range(2)]
    space = lambda n, d: spark.createDataFrame([(f"c{i}", [float(i)] * d) for i in range(n)], "cell_id string, embedding array<double>")
    kept, skipped = merge.merge_reductions([(cells[0], {"pca": space(3, 2), "umap": space(3, 2), "own": space(3, 2)}), (cells[1], {"pca": space(2, 2), "umap": space(3, 3)})])
    assert set(kept) == {"pca"} and set(skipped) == {"umap"} and "2, 3" in skipped["umap"]
    assert {r.cell_id: r.embedding for r in kept["pca"].collect()} == {f"s{k}_c{i}": None if (k, i) == (1, 2) else [float(i)] * 2 for k in range(2) for i in range(3)}
