"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Quality rules drop rejected documents; line dedup deletes later copies of line runs from the texts; near-dedup keeps the
document of smallest doc_id of each group of texts whose five-word shingles have Jaccard 0.8 or more; decontamination drops documents that hold a benchmark item; BPE gives the ids.

Defined cases are those of the operators: null and empty texts fail the quality rules; rows of a null doc_id are judged, cut, compared, dropped and encoded each by its own
text; of near-duplicates the smallest doc_id stays, null last; repeated rows are near-duplicates; very long texts are read whole; empty tables stay empty; other columns pass
through, whatever their names. All but the last stage return the columns of documents, n_chars following
text. SQL can't express the stages (hashed models, reachability, edit distance, BPE), so ORACLE_SQL is None; the stages are tested
against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplan.llm import bpe, decontaminate, linedup, neardup, quality_rules
from cytoplan.llm.common import packed, read, unpacked, with_copy_numbers, written

ORACLE_SQL = None
#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ratios = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.judge(packed(docs), ratios, "row").where("kept").select(unpacked(docs.columns))


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linedup.dedup(packed(docs), "row")
    return cut.select(unpacked(docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_copy_numbers(packed(docs), "row")
    first = neardup.first_copies(rows, SHINGLE)
    kept = rows.join(first, rows.doc_id.eqNullSafe(first.doc_id) & (rows.copy == first.copy), "left_semi")
    return kept.select(unpacked(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (4 bytes each), and digests of the ids and of the text that they decode to."""
    rows = bpe.decode(bpe.encode(docs))
    return rows.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", line_runs),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
