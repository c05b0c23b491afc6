"""Quality by importance resampling (operator 1).

Hashed n-gram multinomials are fitted on the target (trusted labelled texts, at most ``MAX_TRUSTED``) and on all raw
texts; a text's log weight is the sum over its n-grams of the log ratio of both. Adding Gumbel noise and
keeping the k highest samples k texts without replacement, in proportion to their weights. k is a share of all rows. The
k-th highest value is found by counting values in ever finer bins, so no global sort and no
large limit is needed.

The noise comes from a hash of doc_id and seed (of the text and seed, where doc_id is null): a rerun, or a lost executor, gives the same sample.

Defined cases: null and empty texts have the weight 0 of an empty product minus ``EMPTY_PENALTY``, so they come
last; repeated rows are rows of their own, but those of one doc_id share their noise, and so do equal texts of a null doc_id; very long texts are read whole; ties at the k-th value are all kept; an empty table gives an
empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.llm import ngrams
from cytoplan.llm.common import words_of, written
from cytoplan.llm.quality_rules import MAX_TRUSTED, fit

KEEP_SHARE, SEED, EMPTY_PENALTY = 0.8, 11, 1 << 40


def scores(documents: DataFrame, ratios: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and key: the noisy log weight in whole multiples of 2**-20."""
    docs = documents.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id")).alias("draw"), words_of(F.col("text")).alias("words"))
    bins = docs.select("doc_id", "draw", F.size("words").alias("n"), ngrams.buckets_of(F.col("words")).alias("bins"))
    total = ngrams.ratio_sum(F.col("bins"), ratios) - F.when(F.col("n") == 0, F.lit(EMPTY_PENALTY)).otherwise(F.lit(0))
    out = bins.select("doc_id", "draw", total.alias("total"))
    # A hash as a number strictly between 0 and 1.
    u = (F.pmod(F.col("draw"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    noise = F.round(-F.log(-F.log(u)) * ngrams.SCALE).cast("long")
    return out.select("doc_id", (F.col("total") / ngrams.SCALE).alias("log_weight"), (F.col("total") + noise).alias("key"))


def kth_highest(scored: DataFrame, k: int, bits: int = 14) -> int | None:
    """The k-th highest key: each pass counts the keys of one range in 2**bits bins at most."""
    low, high = scored.agg(F.min("key"), F.max("key")).first()
    if low is None or k < 1:
        return None
    while low < high:
        width = max(1, -(-(high - low + 1) >> bits))
        bin_of = F.floor((F.col("key") - F.lit(low)) / F.lit(width)) if width == 1 else F.expr(f"(key - {low}L) div {width}L")
        rows = scored.where(F.col("key").between(low, high)).groupBy(bin_of.cast("long").alias("bin")).count().collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if k <= r["count"]:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            k -= r["count"]
        else:
            return low
    return low


def resample(documents: DataFrame, labels: DataFrame, share: float = KEEP_SHARE, max_trusted: int = MAX_TRUSTED, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and gumbel_key of the sampled rows."""
    scored = written(scores(documents, fit(documents, labels, max_trusted), seed), "weights")
    cut = kth_highest(scored, int(share * scored.count()))
    kept = scored.where(F.lit(False)) if cut is None else scored.where(F.col("key") >= F.lit(cut))
    return kept.select("doc_id", "log_weight", (F.col("key") / ngrams.SCALE).alias("gumbel_key"))
