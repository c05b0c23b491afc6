"""Deletes later copies of repeated line runs: a suffix array over line-ID sequences (operator 8).

Every document is a sequence of line ids. A run of lines counts if it has ``MIN_WORDS`` words or more. Its windows are
the shortest such runs that start at a line and those that end at a line; the content of a window is all that
decides whether it is one. Prefix doubling names runs of 1, 2, 4 ... lines: the name of a run is the first place where
it stands, (doc_id, row, line), so equal names mean equal runs and a name is the head of the interval of suffixes that share
this prefix. A run of twice the length is named by the pair of names of its halves, a window by the two (overlapping)
powers of two that cover it. Lines that stand once are dropped after the first naming, and runs as soon as they are
unique, so that later rounds handle repeated text only. Every window whose name is an earlier place is a later copy. A line
of a repeated run has MIN_WORDS words from it to the end of the run, or from the start of the run to it, or else the
window from the start of the run goes beyond it; so the union of both kinds of windows is the maximal repeated run, and
its lines are deleted. No window has more than MIN_WORDS lines, as every line in it has a word.

Doubling stops at 16 lines, though longer runs repeat: a name is an interval of the suffix array (the suffixes that share a prefix), and the
intervals of longer prefixes only repeat what the windows have decided, as every longer repeated run is a union of repeated windows.

All naming is grouped minima with map-side combining and joins on names; no group of copies is gathered, and the most frequent lines and
runs are joined by a broadcast of bounded size, so a boilerplate that a third of all documents hold is no task of its own.

Defined cases: lines without words are never deleted and count no words; null texts stay null; rows of a null doc_id stand before
those of doc_id 0; repeated rows of a
doc_id are told apart by a hash of their text and row; ties cannot arise, as places are distinct; very long texts are cut into lines like any other; an empty table gives an
empty result; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.llm.common import SEPARATORS, join_with_hot_keys, with_copy_numbers, written

MIN_WORDS = 10


def lines_of(documents: DataFrame) -> DataFrame:
    """key (doc_id, copy), k (the place among lines with words), line (its place in the text), h1, h2, n."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    at = documents.select("doc_id", "copy", F.posexplode(lines).alias("line", "t"))
    words = F.size(F.filter(F.split("t", SEPARATORS + "+"), lambda w: w != ""))
    return at.select("doc_id", "copy", "line", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), words.alias("n")).where("n > 0")


PLACE = ("doc_id", "copy", "line")


def _firsts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The first place of the rows of equal keys, and their number, where there are several."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*PLACE)).alias(name), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def _name(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds to rows (a written table) the first place of their keys; rows whose keys stand once are dropped."""
    return join_with_hot_keys(rows, _firsts(rows, keys, name), keys, "copies").drop("copies")


def later_copies(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, copy, line) of every line to delete. documents: doc_id, copy, text."""
    order = Window.partitionBy("doc_id", "copy").orderBy("line")
    lines = lines_of(documents)
    # How many lines the windows from each line have, from the word counts of this line and the next ones: no shorter run
    # from this line has enough words, or none to the same end.
    ahead = F.collect_list("n").over(order.rowsBetween(0, min_words - 1))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"), F.array().cast("array<int>").alias("sizes"))
    got = F.aggregate(
        F.col("ahead"), start,
        lambda s, n: F.struct(
            (s["words"] + n).alias("words"), (s["lines"] + 1).alias("lines"),
            F.when((s["words"] + n >= min_words) & ((s["words"] < min_words) | (s["words"] + n - F.col("n") < min_words)), F.concat(s["sizes"], F.array(s["lines"] + 1))).otherwise(s["sizes"]).alias("sizes"),
        ),
    )
    lines = lines.select(*PLACE, "h1", "h2", "n", ahead.alias("ahead"), F.row_number().over(order).alias("k"))
    lines = lines.select(*PLACE, "h1", "h2", got["sizes"].alias("sizes"), "k")
    lines = written(lines, "lines")
    named = written(_name(lines, ["h1", "h2"], "a").select(*PLACE, "k", "sizes", "a"), "names")
    gone = named.where(F.array_contains("sizes", 1)).where(F.col("a") != F.struct(*PLACE)).select("doc_id", "copy", "k")
    width = 1
    while width < min_words:
        # Windows of width + 1 ... 2 * width lines: a run of width lines here, and one that ends with the window. The runs of
        # 2 * width lines, which the next round needs, are found beside them; a window of that size is such a run, of the same name.
        ends = named.select("doc_id", "copy", F.col("k").alias("k2"), F.col("a").alias("b"))
        wanted = F.filter("sizes", lambda n: (n > width) & (n <= 2 * width))
        if 2 * width < min_words:
            wanted = F.array_union(wanted, F.array(F.lit(2 * width)))
        wide = named.select(*PLACE, "k", "sizes", "a", F.explode(wanted).alias("size")).withColumn("k2", F.col("k") + F.col("size") - width)
        runs = _name(written(wide.join(ends, ["doc_id", "copy", "k2"]), "runs"), ["size", "a", "b"], "c").select(*PLACE, "k", "sizes", "size", "c")
        if 2 * width < min_words:
            runs = written(runs, "names")
            named = runs.where(F.col("size") == 2 * width).select(*PLACE, "k", "sizes", F.col("c").alias("a"))
        last = runs.where(F.array_contains("sizes", F.col("size")) & (F.col("c") != F.struct(*PLACE)))
        gone = gone.unionByName(last.select("doc_id", "copy", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("size") - 1)).alias("k")))
        width *= 2
    return gone.distinct().join(lines.select(*PLACE, "k"), ["doc_id", "copy", "k"]).select(*PLACE)


def dedup(documents: DataFrame, *carry: str, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, copy, the columns to carry, text without later copies of line runs, and n_removed, the count of deleted lines."""
    docs = with_copy_numbers(documents, *carry)
    # Joins match no nulls: a null doc_id goes as 0, with copy numbers that no other row has.
    doc_id = F.coalesce(docs.doc_id, F.lit(0).cast(docs.schema["doc_id"].dataType))
    copy = F.when(docs.doc_id.isNull(), docs.copy - F.lit(2**31)).otherwise(docs.copy).cast("int")
    gone = later_copies(docs.select(doc_id.alias("doc_id"), copy.alias("copy"), "text"), min_words).groupBy("doc_id", "copy").agg(F.collect_set("line").alias("gone"))
    numbered = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    left = F.filter(numbered, lambda x: ~F.array_contains("gone", x["i"]))["t"]
    both = docs.join(gone, [doc_id == gone.doc_id, copy == gone.copy], "left")
    return both.select(
        docs.doc_id, docs.copy, *(docs[c] for c in carry),
        F.when(F.col("gone").isNull(), docs.text).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).alias("n_removed"),
    )
