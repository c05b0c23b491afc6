"""Routes and branches on a cluster graph, and temporal refinement of clusters.

Clusters are few: paths are found by the driver, behind a check of the graph's size. What handles cells stays distributed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.operators.trajectory import typical_step

MAX_EDGES = 200_000
EPS = 1e-8


class Routes:
    """The routes from a root to every cluster: along the edges, or, where these lead nowhere, against them, too."""

    def __init__(self, edges: DataFrame, root):
        rows = edges.select("from_cluster", "to_cluster", "weight").limit(MAX_EDGES + 1).collect()
        if len(rows) > MAX_EDGES:
            raise ValueError(f"a cluster graph of more than {MAX_EDGES} edges")
        on, both = {}, {}
        for r in rows:
            for of, a, b in ((on, r.from_cluster, r.to_cluster), (both, r.from_cluster, r.to_cluster), (both, r.to_cluster, r.from_cluster)):
                of.setdefault(a, {})[b] = of.get(a, {}).get(b, 0.0) + (r.weight or 0.0)
        self.root = root
        self._directed, self._undirected = self._tree(on), self._tree(both)

    def _tree(self, near: dict) -> dict:
        """Every reached cluster and the one before it on its shortest way."""
        best, before, todo = {self.root: 0.0}, {self.root: None}, [(0.0, str(self.root), self.root)]
        while todo:
            length, _, x = heapq.heappop(todo)
            if length > best[x]:
                continue
            for y, w in sorted(near.get(x, {}).items(), key=str):
                if (longer := length + 1 / max(w, EPS)) < best.get(y, float("inf")):
                    best[y], before[y] = longer, x
                    heapq.heappush(todo, (longer, str(y), y))
        return before

    def to(self, target) -> list:
        """The clusters from the root to the target; none if it can't be reached."""
        tree = self._directed if target in self._directed else self._undirected
        way, x = [], target if target in tree else None
        while x is not None:
            way.append(x)
            x = tree[x]
        return way[::-1]


def _first_after_fork(ways: dict) -> dict:
    """For each target, the cluster that its way takes behind what all ways have in common."""
    shared = 0
    while all(len(w) > shared for w in ways.values()) and len({w[shared] for w in ways.values()}) == 1:
        shared += 1
    return {t: w[shared] if len(w) > shared else w[-1] for t, w in ways.items()}


def _latest(targets: Iterable, pt: dict):
    known = [t for t in targets if pt.get(t) is not None]
    return max(known, key=lambda t: pt[t]) if known else None


def collapsed_terminals(routes: Routes, terminals: list, pt: dict) -> list:
    """One terminal for each branch, the latest. Terminals that no way reaches are kept only if none or one is reached."""
    ways = {t: w for t in terminals if (w := routes.to(t))}
    if len(ways) <= 1:
        return list(terminals)
    forks = _first_after_fork(ways)
    chosen = [_latest([t for t in ways if forks[t] == key], pt) for key in sorted(set(forks.values()), key=str)]
    return [t for t in chosen if t is not None]


def expected_terminals(routes: Routes, clusters: list, terminals: list, pt: dict, expected: int) -> list:
    """`expected` ends: the latest cluster of each branch, latest first, then the latest of the others."""
    expected = max(1, int(expected))
    others = [c for c in clusters if c != routes.root and pt.get(c) is not None]
    late = lambda names: sorted(names, key=lambda c: (-pt[c], str(c)))
    ways = {c: w for c in others if len(w := routes.to(c)) > 1}
    if not ways:
        return late([t for t in terminals if pt.get(t) is not None])[:expected]
    forks = _first_after_fork(ways)
    ends = late([_latest([c for c in ways if forks[c] == key], pt) for key in set(forks.values())])
    return (ends + [c for c in late(others) if c not in ends])[:expected]


def refined_clusters(
    cells: DataFrame, min_size: int = 60, min_share: float = 0.20, min_gap: float = 1.1, min_between: float = 0.30, min_separation: float | None = 0.55
) -> DataFrame:
    """(id, cluster): clusters split in two where their times fall apart, named C1, C2 ... by median time. cells: id, cluster, time, v.

    The best split of times into two groups is found from the counts of each cluster's times. It holds if both parts are large enough, their means
    lie apart by steps of time and explain enough of the variance, and the parts are apart in the first five dimensions, too
    (min_separation None: not asked for). With a missing time nothing is split, and names stay.
    """
    named = cells.select("id", F.col("cluster").cast("string").alias("cluster"), F.col("time").cast("double").alias("time"), *(["v"] if min_separation is not None else []))
    if not named.where("time is null or isnan(time)").isEmpty():
        return named.select("id", "cluster")
    step = F.broadcast(typical_step(named))  # one row
    spread = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), (F.percentile("time", F.lit(0.75)) - F.percentile("time", F.lit(0.25))).alias("iqr"))
    wide = spread.crossJoin(step).where((F.col("n") >= max(6, min_size)) & (F.col("iqr") >= F.col("step"))).select("cluster", "step")
    counts = named.groupBy("cluster", "time").agg(F.count(F.lit(1)).alias("n"))  # a row for each time point of a cluster
    own = Window.partitionBy("cluster")
    to_here = own.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    n, s, q = F.col("n"), F.col("n") * F.col("time"), F.col("n") * F.col("time") * F.col("time")
    cuts = counts.select(
        "cluster", "time", F.sum(n).over(to_here).alias("n1"), F.sum(s).over(to_here).alias("s1"), F.sum(n).over(own).alias("n"), F.sum(s).over(own).alias("s"), F.sum(q).over(own).alias("q")
    ).where("n1 < n")
    n2, s2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1")
    rest = F.col("s") * F.col("s") / F.col("n")
    scored = cuts.select(
        "cluster", "time", (F.col("s1") * F.col("s1") / F.col("n1") + s2 * s2 / n2 - rest).alias("between"), (F.col("q") - rest).alias("total"),
        (F.least(F.col("n1"), n2) / F.col("n")).alias("share"), (s2 / n2 - F.col("s1") / F.col("n1")).alias("gap"),
    )
    best = scored.groupBy("cluster").agg(F.max_by(F.struct("time", "between", "total", "share", "gap"), F.struct(F.round("between", 9), -F.col("time"))).alias("best")).select("cluster", "best.*")
    kept = best.join(wide, "cluster").where((F.col("share") >= min_share) & (F.col("gap") >= min_gap * F.col("step")) & (F.col("between") / F.greatest("total", F.lit(EPS)) >= min_between))
    split = named.join(kept.select("cluster", F.col("time").alias("cut")), "cluster", "left").withColumn("side", F.when(F.col("cut").isNotNull(), F.when(F.col("time") <= F.col("cut"), 1).otherwise(2)))
    if min_separation is not None:
        dims = split.where("side is not null").select("cluster", "side", F.posexplode(F.slice("v", 1, 5)).alias("dim", "x"))
        first, second = F.avg(F.when(F.col("side") == 1, F.col("x"))), F.avg(F.when(F.col("side") == 2, F.col("x")))
        apart = dims.groupBy("cluster", "dim").agg(F.pow((first - second) / F.nullif(F.stddev_samp("x"), F.lit(0.0)), 2).alias("d"))
        far = apart.groupBy("cluster").agg(F.sum("d").alias("d"), F.count("d").alias("k"), F.count(F.lit(1)).alias("of")).where((F.col("k") == F.col("of")) & (F.sqrt("d") >= min_separation))
        split = split.join(far.select("cluster", F.lit(True).alias("far")), "cluster", "left").withColumn("side", F.when(F.col("far"), F.col("side")))
    label = F.when(F.col("side").isNull(), F.col("cluster")).otherwise(F.concat_ws("_", "cluster", F.col("side").cast("string")))
    renamed = split.select("id", "time", label.alias("label"))
    order = renamed.groupBy("label").agg(F.median("time").alias("m"))
    names = order.select("label", F.concat(F.lit("C"), F.row_number().over(Window.orderBy("m", "label")).cast("string")).alias("cluster"))  # a row for each cluster
    return renamed.join(names, "label").select("id", "cluster")
