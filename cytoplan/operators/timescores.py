"""Scores of a pseudotime against known times. Values: id, time, pt."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

from cytoplan.functions.ranking import RANGES, range_of
from cytoplan.functions.settle import settled


def average_ranks(df: DataFrame, column: str, to: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean, from the counts of distinct values.

    Counts are summed over blocks of the value range first, so no single task orders every distinct value.
    """
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v__")).agg(F.count(F.lit(1)).alias("n__"))
    cuts = n.agg(F.percentile_approx("v__", F.array(*(F.lit(k / 64) for k in range(1, 64)))).alias("cuts__"))
    block = F.size(F.filter("cuts__", lambda c: c < F.col("v__")))
    blocked = n.crossJoin(F.broadcast(cuts)).select("v__", "n__", block.alias("b__"))  # one row of 63 cuts
    sizes = blocked.groupBy("b__").agg(F.sum("n__").alias("s__"))
    start = sizes.select("b__", (F.sum("s__").over(Window.orderBy("b__")) - F.col("s__")).alias("start__"))  # 64 rows
    inside = F.sum("n__").over(Window.partitionBy("b__").orderBy("v__").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = blocked.withColumn("upto__", inside).join(F.broadcast(start), "b__")
    rank = F.col("start__") + F.col("upto__") - (F.col("n__") - 1) / 2
    return df.join(ranks.select(F.col("v__"), rank.alias(to)), F.col(column) == F.col("v__"), "left").drop("v__")


def correlation(values: DataFrame, x: str, y: str, method: str = "spearman") -> DataFrame:
    """One row with `r`: null for a constant column or fewer than two pairs. Kendall is tau-b, its rising pairs counted by merging."""
    own = values.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if method == "spearman":
        own = average_ranks(average_ranks(own, "x", "rx"), "y", "ry").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    if method in ("spearman", "pearson"):
        ok = (F.count(F.lit(1)) >= 2) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
        return own.agg(F.when(ok, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("r"))
    if method != "kendall":
        raise ValueError(f"unknown method {method}")
    n = settled(own.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    tied = lambda *c: n.groupBy(*c).agg(F.sum("n").alias("m")).agg(F.coalesce(F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("decimal(38,0)")), F.lit(0)).alias("t")).first().t
    m = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs, tx, ty, both = m * (m - 1) // 2, int(tied("x")), int(tied("y")), int(tied("x", "y"))
    size = math.sqrt((pairs - tx) * (pairs - ty))
    net = 2 * rising_pairs(n) - (pairs - tx - ty + both)
    return values.sparkSession.createDataFrame([(net / size if size > 0 else None,)], "r double")


def rising(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> int:
    """Sum of n[a] * n[b] over all a, b with first[a] < first[b] and second[a] < second[b], by merging halves of twice the width each time."""
    order = np.lexsort((-second, first))  # of equal firsts the larger second stands before: such pairs do not rise
    y, n = second[order], n[order].astype(object if float(n.sum()) ** 2 > 2.0**62 else np.int64)
    total, width, at = 0, 1, np.arange(len(y))
    while width < len(y):
        half, pair = at // width & 1, at // (2 * width)
        by = np.lexsort((1 - half, y, pair))  # of equal seconds the later half stands before
        left = np.where(half[by] == 0, n[by], 0)
        below = np.cumsum(left)
        start = np.searchsorted(pair[by], pair[by])
        total += int((np.where(half[by] == 1, n[by], 0) * (below - np.where(start > 0, below[np.maximum(start - 1, 0)], 0))).sum())
        width *= 2
    return total


def _counter(first: str, second: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [str(rising(frame[first].to_numpy(), frame[second].to_numpy(), frame["n"].to_numpy()))]})

    return counted


def rising_pairs(n: DataFrame) -> int:
    """Pairs of rows of which one is larger in x and in y. n: x, y, n, distinct points and their rows.

    x and y are cut into ranges. Pairs in different ranges of both follow from the counts of the grid of ranges, which is of fixed size;
    those in one range of y but several of x are counted in the task of that range of y; those in one range of x in the task of that range of x. A value that many
    points share is a range of its own, which holds no such pair and goes to no task.
    """
    cuts, alone = {}, {}
    for c in "xy":
        got = n.agg(F.percentile_approx(c, [k / RANGES for k in range(1, RANGES + 1)], 20 * RANGES)).first()[0] or []
        often = {v for v, w in zip(got[:-1], got[1:], strict=True) if v == w}
        cuts[c] = sorted(set(got) | {float(np.nextafter(v, -np.inf)) for v in often})
        alone[c] = [cuts[c].index(v) for v in often]
    placed = settled(n.select("x", "y", "n", range_of("x", cuts["x"]).alias("i"), range_of("y", cuts["y"]).alias("j")))
    grid = placed.groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()  # squares of ranges
    table = np.zeros((len(cuts["x"]) + 1, len(cuts["y"]) + 1), object)
    for i, j, k in zip(grid.i, grid.j, grid.n, strict=True):
        table[i, j] = int(k)
    below = np.zeros_like(table)
    below[1:, 1:] = table.cumsum(0).cumsum(1)[:-1, :-1]
    total = int((table * below).sum())
    # One row for each point: a range of y is asked for pairs in several ranges of x, a range of x for pairs within it.
    for key, first, second in (("j", "y", "i"), ("i", "x", "y")):
        rows = placed.where(~F.col(key).isin(alone["y" if key == "j" else "x"])) if alone["y" if key == "j" else "x"] else placed

        got = rows.groupBy(key).applyInPandas(_counter(first, second), "s string").agg(F.sum(F.col("s").cast("decimal(38,0)"))).first()[0]
        total += int(got or 0)
    return total


def _unit(column: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, column * 0.0).otherwise((column - low) / (high - low))


def orient(values: DataFrame, method: str = "spearman") -> DataFrame:
    """id, oriented: pt on the unit scale, turned round where it falls with time; null for all below three pairs."""
    ok = F.col("pt").isNotNull() & F.col("time").isNotNull() & ~F.isnan("pt")
    good = values.where(ok)
    facts = good.agg(F.count(F.lit(1)).alias("n"), F.min("pt").alias("low"), F.max("pt").alias("high")).crossJoin(correlation(good, "pt", "time", method))
    unit = _unit(F.col("pt"), F.col("low"), F.col("high"))
    turned = F.when((F.col("r") < 0) & (F.col("high") > F.col("low")), 1 - unit).otherwise(unit)
    return values.crossJoin(F.broadcast(facts)).select("id", F.when((F.col("n") >= 3) & ok, turned).alias("oriented"))  # one row


def adjacent_auc(values: DataFrame, group: str, min_cells: int = 1) -> DataFrame:
    """Chance that a later cell has the larger pt, for each group and two times that follow each other (in all groups together)."""
    good = values.where("pt is not null and time is not null and not isnan(pt)").select(F.col(group).alias("group"), F.col("time").cast("double").alias("time"), "pt")
    levels = values.where("time is not null").select(F.col("time").cast("double").alias("time")).distinct()
    nexts = levels.select("time", F.lead("time").over(Window.orderBy("time")).alias("later")).where("later is not null")  # a row for each time
    # Equal values are combined first; every cell serves as the earlier side of one comparison and the later of another.
    n = good.groupBy("group", "time", "pt").agg(F.count(F.lit(1)).alias("n"))
    early = n.join(F.broadcast(nexts), "time").select("group", F.col("time").alias("time_earlier"), F.col("later").alias("time_later"), "pt", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    late = n.join(F.broadcast(nexts.toDF("earlier", "time")), "time").select("group", F.col("earlier").alias("time_earlier"), F.col("time").alias("time_later"), "pt", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    keys = ["group", "time_earlier", "time_later"]
    both = early.union(late).groupBy(*keys, "pt").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    below = F.coalesce(F.sum("a").over(Window.partitionBy(*keys).orderBy("pt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = both.withColumn("wins", F.col("b") * (below + F.col("a") / 2))
    got = wins.groupBy(*keys).agg(F.sum("a").alias("n_earlier"), F.sum("b").alias("n_later"), F.sum("wins").alias("wins"))
    enough = got.where((F.col("n_earlier") >= F.greatest(F.lit(min_cells), F.lit(1))) & (F.col("n_later") >= F.greatest(F.lit(min_cells), F.lit(1))))
    weight = F.col("n_earlier") * F.col("n_later")
    return enough.select(*keys, "n_earlier", "n_later", (F.col("wins") / weight).alias("auc"), weight.alias("weight"))


def auc_summary(pairs: DataFrame, weighted: bool = True) -> DataFrame:
    mean = F.sum(F.col("auc") * F.col("weight")) / F.sum("weight") if weighted else F.avg("auc")
    return pairs.agg(mean.alias("adjacent_timepoint_auc"), F.count(F.lit(1)).alias("n_valid_comparisons"))


def branch_onset(cells: DataFrame, truth: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Median pt of the committed cells of each branch. cells: branch, pt, activation; truth: branch, true_onset."""
    kept = cells.where((F.col("activation") >= threshold) & F.col("pt").isNotNull() & ~F.isnan("pt") & ~F.isnan("activation"))
    n = kept.groupBy("branch").agg(F.median("pt").alias("inferred_onset"), F.count(F.lit(1)).alias("n_committed_cells"))
    return truth.join(n, "branch", "left").na.fill(0, ["n_committed_cells"])


def onset_summary(onsets: DataFrame) -> DataFrame:
    valid = onsets.where("true_onset is not null and inferred_onset is not null")
    ends = valid.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("true_onset", "inferred_onset") for k, f in (("lo", F.min), ("hi", F.max))))
    unit = lambda c: _unit(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    mae = valid.crossJoin(F.broadcast(ends)).agg(F.avg(F.abs(unit("true_onset") - unit("inferred_onset"))).alias("mae"))
    tau = correlation(valid, "true_onset", "inferred_onset", "kendall").toDF("tau")
    rho = correlation(valid, "true_onset", "inferred_onset", "spearman").toDF("rho")
    full = ends.select("n").crossJoin(mae).crossJoin(tau).crossJoin(rho)  # one row each
    if_two = lambda c: F.when(F.col("n") >= 2, c)
    return full.select(
        F.col("n").alias("n_branches_used"), if_two(F.col("tau")).alias("kendall_tau"), if_two(F.col("rho")).alias("spearman_rho"), if_two(F.col("mae")).alias("normalized_onset_mae"),
        if_two((F.col("tau") + 1) / 2).alias("order_score"), if_two(1 - F.col("mae")).alias("accuracy"),
    )


def reachable(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """All (from_cluster, to_cluster) with a directed path; doubling its length each round. For graphs of clusters, not of cells."""
    now = settled(edges.select("from_cluster", "to_cluster").distinct())
    size = now.count()
    for _ in range(max_rounds):
        further = now.toDF("from_cluster", "m").join(now.toDF("m", "to_cluster"), "m").select("from_cluster", "to_cluster")
        now = settled(now.union(further).distinct())
        before, size = size, now.count()
        if size == before:
            return now
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def reachability(edges: DataFrame, clusters: DataFrame, min_gap: float = 0.0, by_cells: bool = True) -> DataFrame:
    """Whether later clusters can be reached from earlier ones and not back. clusters: cluster, median, n."""
    paths = reachable(edges).withColumn("hit", F.lit(True))
    a, b = clusters.toDF("earlier", "m1", "n1"), clusters.toDF("later", "m2", "n2")
    pairs = a.join(b, (F.col("earlier") != F.col("later")) & (F.col("m2") - F.col("m1") > min_gap))
    full = pairs.join(paths.toDF("earlier", "later", "on"), ["earlier", "later"], "left").join(paths.toDF("later", "earlier", "back"), ["earlier", "later"], "left")
    score = F.when(F.col("on").isNull(), 0.0).when(F.col("back").isNull(), 1.0).otherwise(0.5)
    weight = F.col("n1") * F.col("n2") if by_cells else F.lit(1)
    return full.select("earlier", "later", (F.col("m2") - F.col("m1")).alias("gap"), score.alias("score"), weight.cast("double").alias("weight"))


def reachability_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("concordance"))
