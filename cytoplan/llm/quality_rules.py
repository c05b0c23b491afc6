"""Quality rules: hashed n-gram log-likelihood ratio with a deterministic threshold (operator 5).

Every text gets a set of counts, a hard rule on them, and the length-normalised log-likelihood ratio of
its hashed n-grams between a trusted-target and a raw-corpus multinomial. The main path is built-in
functions only. Counting for the raw model covers every text; the target model is fitted on at most
``max_trusted`` labelled rows, chosen by a hash of doc_id.

Defined cases: a null or blank text has no words, all counts 0 and fails the base rule; repeated rows
are judged each by itself, those of a null doc_id, too; very long texts are read whole; an empty documents table gives an empty result; without trusted rows the
target model is uniform; columns of documents other than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.llm import ngrams
from cytoplan.llm.common import SEPARATORS, words_of

#: Base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A text whose mean log ratio for each n-gram is below this is rejected.
THRESHOLD = -0.035
#: Bound on the labelled rows that the target model is fitted on.
MAX_TRUSTED = 20_000


def base_counts(documents: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the columns to carry, words, and the base columns n_words ... base_failed for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, SEPARATORS + "+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SEPARATORS + "+", "") != "")
    a = documents.select(
        "doc_id",
        *carry,
        words_of(F.col("text")).alias("words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    w = F.col("words")
    a = a.select(
        "doc_id",
        *carry,
        "words",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x)
        ).alias("triples"),
    )
    # Texts without a repeated window stop here: only the others are sorted.
    repeats = F.size(F.array_distinct("triples")) < F.size("triples")
    order = F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.withColumn("order", F.when(repeats, order)).drop("triples")
    o = F.col("order")
    same = lambda e, i: (e["h"] == F.get(o, i - 1)["h"]) | (e["h"] == F.get(o, i + 1)["h"])
    a = a.withColumn("at", F.sort_array(F.transform(F.filter(o, same), lambda e: e["i"]))).drop("order")
    at = F.col("at")
    new = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
    total = F.aggregate(new, F.lit(0).cast("long"), lambda acc, x: acc + x)
    a = a.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return a.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """At most max_trusted ids of rows labelled as good."""
    return (
        labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_trusted)
    )


def fit(documents: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> list[int]:
    """The log ratios of the bins. labels: doc_id, quality (1: trusted)."""
    ids = trusted_ids(labels, max_trusted).withColumn("trusted", F.lit(1))
    docs = documents.select("doc_id", words_of(F.col("text")).alias("words"))
    docs = docs.join(F.broadcast(ids), "doc_id", "left")  # max_trusted ids at most
    feats = docs.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), ngrams.buckets_of(F.col("words")).alias("bins"))
    return ngrams.log_ratios(ngrams.counts(feats, F.col("trusted")))


def judge(documents: DataFrame, ratios: list[int], *carry: str, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the columns to carry, the base columns, kept and llr (the mean log ratio) of each row."""
    a = base_counts(documents, *carry)
    judged = F.when(~F.col("base_failed"), F.col("words"))  # the others need no score
    a = a.withColumn("w", judged).withColumn("bins", ngrams.buckets_of(F.col("w"))).drop("w")
    a = a.withColumn("llr_total", ngrams.ratio_sum(F.col("bins"), ratios))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    limit = round(threshold * ngrams.SCALE)
    kept = F.coalesce(~F.col("base_failed") & (F.col("llr_total") >= n * limit), F.lit(False))
    every = F.struct(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), (F.col("llr_total") / (n * ngrams.SCALE)).alias("llr"),
    )
    # A generated row: filters on kept stay above it, instead of repeating the expressions that it is made of.
    return a.select(F.explode_outer(F.array(every)).alias("judged")).select("judged.*")


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on all of documents and the trusted rows of labels, then judge every document."""
    return judge(documents, fit(documents, labels), threshold=threshold)
