"""Two-dimensional layouts of embeddings that keep neighbourhoods (UMAP, McInnes et al. 2018).

points: id, v. Each point's nearest neighbours get memberships by a bandwidth of its own; a pair's membership is the fuzzy union of both directions. The layout begins at
two given coordinates (principal components, say). In each round the points are dealt in blocks of neighbours by id, each with the pairs that begin in it and the places of
their other ends; a task draws its own points closer along their pairs and pushes them from points of a sample of all places, for some epochs. Places of other blocks
stand still during a round, so that no task holds more than its block, its pairs and a sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.functions.settle import forget, settled
from cytoplan.operators import nearindex, neighbors

#: Points of a block; places that stand for all others.
BLOCK, SAMPLE = 4096, 4096


def curve(spread: float = 1.0, min_dist: float = 0.3) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), nearest to one that is 1 up to min_dist and falls by spread beyond (least squares, damped Gauss-Newton)."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.zeros(2)  # logs

    def miss(p: np.ndarray) -> np.ndarray:
        a, b = np.exp(p)
        return 1 / (1 + a * d ** (2 * b)) - want

    damp = 1e-2
    for _ in range(200):
        r = miss(p)
        j = np.stack([(miss(p + e) - miss(p - e)) / 2e-6 for e in 1e-6 * np.eye(2)], 1)
        move = np.linalg.solve(j.T @ j + damp * np.eye(2), -j.T @ r)
        better = (miss(p + move) ** 2).sum() < (r**2).sum()
        p, damp = (p + move, damp / 3) if better else (p, damp * 4)
        if np.abs(move).max() < 1e-9:
            break
    return float(np.exp(p[0])), float(np.exp(p[1]))


def bandwidths(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ascending distances: the least positive one, and the width at which the memberships sum to log2 of the neighbours and one."""
    near = np.where((distances > 0).any(1), np.where(distances > 0, distances, np.inf).min(1, initial=np.inf), 0.0)
    goal = np.log2(distances.shape[1] + 1)
    over = np.maximum(distances - near[:, None], 0)
    low, high, width = np.zeros(len(over)), np.full(len(over), np.inf), np.ones(len(over))
    for _ in range(64):
        many = np.exp(-over / width[:, None]).sum(1) > goal
        high, low = np.where(many, width, high), np.where(many, low, width)
        width = np.where(np.isinf(high), width * 2, (low + high) / 2)
    least = 1e-3 * np.where(near > 0, distances.mean(1), distances.mean() if distances.size else 0.0)
    return near, np.maximum(np.minimum(width, 1e9), np.maximum(least, 1e-12))


def memberships(neighbours: DataFrame, k: int) -> DataFrame:
    """(i, j, w) from both ends: fuzzy unions of the memberships of nearest neighbours (i, j, distance), k of each point."""
    rows = neighbours.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("distance", "j"))).alias("n"))  # k entries

    def graded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            d = np.array([list(x) + [x[-1]] * (k - len(x)) for x in frame["d"]], float)
            near, width = bandwidths(d)
            real = np.array([[True] * len(x) + [False] * (k - len(x)) for x in frame["d"]])
            w = np.exp(-np.maximum(d - near[:, None], 0) / width[:, None])[real]
            yield pd.DataFrame({"i": np.repeat(frame["i"].to_numpy(), real.sum(1)), "j": np.concatenate([np.asarray(x) for x in frame["j"]]), "w": w})

    own = settled(rows.select("i", F.col("n")["distance"].alias("d"), F.col("n")["j"].alias("j")).mapInPandas(graded, "i long, j long, w double"))
    both = own.unionByName(own.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("s"), F.max("w").alias("one"), F.count(F.lit(1)).alias("n"))
    # w + v - w v of the two directions; v is what the sum has beside one of them.
    other = F.when(F.col("n") == 2, F.col("s") - F.col("one")).otherwise(0.0)
    return both.select("i", "j", (F.col("s") - F.col("one") * other).alias("w"))


def _drawn(own: np.ndarray, at: np.ndarray, far: np.ndarray, inside: np.ndarray, places: np.ndarray, w: np.ndarray, others: np.ndarray, a: float, b: float, rates: np.ndarray, negatives: int, rng: np.random.Generator) -> np.ndarray:
    """Places of a block after some epochs. Pair p draws own point at[p] to own point inside[p], or, where that is -1, to places[far[p]]."""
    y, here = own.copy(), inside >= 0
    weight = np.zeros(len(y))
    np.add.at(weight, at, w)
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    for rate in rates:
        end = np.where(here[:, None], y[np.maximum(inside, 0)], places[far])
        gap = y[at] - end
        d2 = (gap**2).sum(1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0.0)
        force = np.clip(pull[:, None] * gap, -4, 4) * w[:, None]
        move, stiff = np.zeros_like(y), np.ones(len(y))
        move[at[order][starts]] = np.add.reduceat(force[order], starts, axis=0)
        stiff[at[order][starts]] += np.add.reduceat(-pull[order] * w[order], starts)
        for _ in range(negatives):
            gap = y - others[rng.integers(0, len(others), len(y))]
            d2 = (gap**2).sum(1)
            push = 2 * b / ((1e-3 + d2) * (1 + a * d2**b))
            move += np.where(d2[:, None] > 1e-12, np.clip(push[:, None] * gap, -4, 4), 0.0) * weight[:, None]
        y += rate * move / stiff[:, None]  # all pairs act at once: a point goes no further than to their balance
    return y


def _drawer(others: np.ndarray, a: float, b: float, rates: np.ndarray, negatives: int, seed: list[int]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The epochs of a round over a block: rows of its own points (own = 1) and of its pairs with the places of their other ends."""

    def drawn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ends = frame[frame["own"] == 1].sort_values("j")
        own, ids = ends[["x", "y"]].to_numpy(), ends["j"].to_numpy()
        p = frame[frame["own"] == 0].sort_values(["i", "j"])
        at, inside = np.searchsorted(ids, p["i"]), np.minimum(np.searchsorted(ids, p["j"]), len(ids) - 1)
        inside = np.where(ids[inside] == p["j"].to_numpy(), inside, -1)
        if len(p):
            own = _drawn(own, at, np.arange(len(p)), inside, p[["x", "y"]].to_numpy(), p["w"].to_numpy(), others, a, b, rates, negatives, np.random.default_rng([*seed, int(key[0])]))
        return pd.DataFrame({"id": ids, "x": own[:, 0], "y": own[:, 1]})

    return drawn


def umap(points: DataFrame, start: DataFrame, k: int = 30, min_dist: float = 0.3, cosine: bool = True, rounds: int = 20, epochs: int = 15, negatives: int = 5, seed: int = 1) -> DataFrame:
    """(id, x, y). start: id, x, y, a first layout, which is scaled to ten units. At least three points; k at most one less than these."""
    rows = settled(points.select("id", F.col("v").cast("array<double>").alias("v")))
    n = rows.count()
    if n < 3:
        raise ValueError("a layout needs three points")
    k = min(k, n - 1)
    unit = settled(neighbors.cosine_normalised(rows)) if cosine else rows
    # Of unit vectors, half of the squared distance is one less the cosine.
    nearest = nearindex.nearest(unit, k).select("i", "j", (F.col("distance") * F.col("distance") / 2 if cosine else F.col("distance")).alias("distance"))
    top = memberships(nearest, k)
    blocks = -(-n // BLOCK)
    block = F.pmod(F.xxhash64("i"), F.lit(blocks))
    pairs = settled(top.where(F.col("w") > 1.0 / (rounds * epochs)).withColumn("block", block))
    facts = start.agg(F.avg("x"), F.avg("y"), F.max(F.greatest(F.abs("x"), F.abs("y")))).first()
    size = 10.0 / facts[2] if facts[2] else 1.0
    jitter = lambda c: (F.pmod(F.xxhash64("id", F.lit(c), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * 1e-3
    now = rows.select("id").join(start.select("id", "x", "y"), "id", "left").select("id", ((F.coalesce("x", F.lit(facts[0])) - facts[0]) * size + jitter("x")).alias("x"), ((F.coalesce("y", F.lit(facts[1])) - facts[1]) * size + jitter("y")).alias("y"))
    now = settled(now)
    a, b = curve(1.0, min_dist)
    for step in range(rounds):
        others = np.array([(r.x, r.y) for r in now.orderBy(F.xxhash64("id", F.lit(step), F.lit(seed)), "id").limit(SAMPLE).collect()])
        rates = 1.0 - (step * epochs + np.arange(epochs)) / (rounds * epochs)

        far = pairs.join(now.withColumnRenamed("id", "j"), "j").select("block", "i", "j", "w", "x", "y", F.lit(0).alias("own"))
        own = now.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("w"), "x", "y", F.lit(1).alias("own"))
        last, now = now, settled(far.unionByName(own).groupBy("block").applyInPandas(_drawer(others, a, b, rates, negatives, [seed, step]), "id long, x double, y double"))
        forget(last)
    return now


def trustworthiness(points: DataFrame, layout: DataFrame, k: int = 15, block: int = 512) -> float:
    """How far neighbours in a layout (id, x, y) are neighbours of the points (id, v), 1 at best (Venna and Kaski 2001); all points with all, in blocks."""
    n = points.count()
    near = settled(neighbors.knn(layout.select("id", F.array("x", "y").alias("v")), k).select("i", "j"))
    ends = near.join(points.select(F.col("id").alias("i"), F.col("v").alias("u")), "i").join(points.select(F.col("id").alias("j"), "v"), "j")
    wanted = ends.groupBy(F.col("i").alias("id")).agg(F.first("u").alias("v"), F.array_sort(F.collect_list(F.round(F.sqrt(F.aggregate(F.zip_with("u", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), 9))).alias("d"))
    pairs = neighbors.block_pairs(wanted.select("id", "v", "d"), block)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for left, right in zip(frame["left"], frame["right"], strict=True):
                i, x = np.array([r["id"] for r in left]), np.array([r["v"] for r in left])
                j, y = np.array([r["id"] for r in right]), np.array([r["v"] for r in right])
                for at, r in enumerate(left):
                    d = np.sort(np.round(np.sqrt(((y - x[at]) ** 2).sum(1)), 9)[j != i[at]])
                    yield pd.DataFrame({"i": i[at], "k": np.arange(len(r["d"])), "closer": np.searchsorted(d, r["d"])})

    ranks = pairs.mapInPandas(counted, "i long, k long, closer long").groupBy("i", "k").agg(F.sum("closer").alias("closer"))
    lost = ranks.agg(F.sum(F.greatest(F.col("closer") + 1 - k, F.lit(0)))).first()[0]
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))
