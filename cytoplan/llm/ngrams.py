"""Hashed word n-gram multinomials with built-in functions only.

A text's features are its words and its pairs of neighbouring words, each hashed with 64-bit xxHash
into one of ``buckets`` bins. Counting is one explode with map-side combining, so that at most
``buckets`` rows leave a task; a model is a table of ``buckets`` counts, whatever the corpus size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Bins, as in the published importance-resampling experiments.
BUCKETS = 10_000
#: Log ratios are kept as whole multiples of 2**-20, so that sums do not depend on their order.
SCALE = 1 << 20
#: Weight of the raw corpus in a bin's target count.
PRIOR = 64


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """Bins of a text's words, then of its word pairs; ``words`` must be a plain column."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.pmod(F.xxhash64(F.get(words, i), w), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def counts(features: DataFrame, trusted: Column) -> dict[int, tuple[int, int]]:
    """Bin -> (count in all texts, count in trusted texts). features: column ``bins``."""
    rows = (
        # The outer form: for the plain one the optimizer infers a filter that computes the bins twice.
        features.select(trusted.cast("long").alias("t"), F.explode_outer("bins").alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("m"))
    )
    return {r.bin: (r.n, r.m or 0) for r in rows.collect()}  # at most `buckets` rows


def log_ratios(found: dict[int, tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Per bin: log(target probability / raw probability), times SCALE.

    The target's counts start from PRIOR n-grams drawn from the raw corpus, so that a bin with few counts has a
    ratio near 1, however small the target.
    """
    raw, target = sum(n for n, _ in found.values()), sum(m for _, m in found.values())
    share = max(target, 1) / max(raw, 1)
    out = []
    for b in range(buckets):
        n, m = found.get(b, (0, 0))
        out.append(round(SCALE * math.log((m + PRIOR * share) / ((n + PRIOR) * share))))
    return out


def table(values: list[int]) -> Column:
    """A constant array; the optimizer folds it to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def ratio_sum(bins: Column, ratios: list[int]) -> Column:
    """Sum of the log ratios of a text's bins, times SCALE (a long)."""
    lookup = table(ratios)
    return F.aggregate(bins, F.lit(0).cast("long"), lambda acc, b: acc + F.get(lookup, b))
