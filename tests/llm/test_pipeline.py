"""The pipeline's stages against what their operators say, and its shape on awkward rows."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from cytoplan.llm import decontaminate, quality_rules, simhash
from cytoplan.llm.common import read

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read(spark, DATA, "documents"), []
    for _, stage in pipeline.STAGES:
        out.append(docs)
        docs = stage(spark, docs, DATA)
        docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-{len(out)}")
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "bpe"]


def test_stages_do_what_their_operators_decide(spark, steps):
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in steps]
    judged = quality_rules.quality_rules(steps[0], read(spark, DATA, "labels"))
    assert ids[1] == sorted(r.doc_id for r in judged.where("kept").collect()) and len(ids[1]) < len(ids[0])
    assert ids[2] == ids[1] and steps[2].where("n_chars != length(text)").isEmpty()
    classes = simhash.near_duplicates(steps[2], shingle=pipeline.SHINGLE)
    assert ids[3] == sorted({r.component_id for r in classes.collect()})
    bad = {r.doc_id for r in decontaminate.contamination(steps[3], read(spark, DATA, "benchmark")).collect()}
    assert ids[4] == [i for i in ids[3] if i not in bad] == ids[5]
    both = steps[5].join(steps[4], "doc_id").where(F.sha2(F.col("text").cast("binary"), 256) != F.col("decoded_sha256"))
    assert both.isEmpty()


def test_clashing_columns_and_repeated_rows(spark):
    text = read(spark, DATA, "documents").where("doc_id = 0").first().text
    rows = [(1, text, "a", 1, 2), (1, text, "a", 1, 2), (2, text, "b", 1, 2), (3, None, "c", 1, 2), (4, "", "d", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, copy int, words int")
    for _, stage in pipeline.STAGES[:4]:
        for d in (docs, docs.limit(0)):
            got = stage(spark, d, DATA)
            assert got.columns == docs.columns
            got.collect()
    assert pipeline.near_duplicates(spark, docs.where("doc_id < 3"), DATA).count() == 1
