"""Null doc_ids in the stages."""

from cytoplan.llm import decontaminate, linedup

RUN = "six words are in this line\nand six words in this one"


def test_runs_in_documents_of_null_id(spark):
    rows = [(None, f"{RUN}\nx"), (None, f"{RUN}\ny"), (0, f"{RUN}\nz")]
    got = linedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == [rows[0][1], "y", "z"]
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 2]


def test_contaminated_document_of_null_id_goes_alone(spark):
    item = " ".join(f"item{k}" for k in range(20))
    docs = spark.createDataFrame([(None, f"before {item} after"), (None, "clean"), (3, item), (3, "clean, too"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.without_contaminated(docs, items).collect()
    assert sorted(str(r.text) for r in got) == ["None", "clean", "clean, too"]
