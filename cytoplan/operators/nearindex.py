"""Approximate nearest neighbours by an index of pivots, for more points than a comparison of all pairs allows; and the choice between the two."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.functions.settle import forget
from cytoplan.operators import blockwise
from cytoplan.operators.blockwise import BLOCK
from cytoplan.operators.neighbors import knn

#: Points that share a pivot on average, and pivots at most (they are sent to every task).
CELL, MAX_PIVOTS = 1000, 4096
#: Points up to which all pairs are compared where nothing else is asked for.
EXACT = 20_000
#: Points whose true neighbours decide how many cells to look into, and the share of these neighbours to find.
SAMPLE, RECALL = 256, 0.95


def pivots(points: DataFrame, cell: int = CELL) -> np.ndarray:
    """Vectors of the points of least hash, one for every `cell` points, MAX_PIVOTS at most."""
    many = min(MAX_PIVOTS, max(1, points.count() // cell))
    return np.array([r.v for r in points.orderBy(F.xxhash64("id"), "id").limit(many).select("v").collect()], float)


def _nearest(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """i, j and distance of the k nearest of y for every x, itself (the same id) left out."""
    for at in range(0, len(i), 64):
        d = np.round(np.sqrt(((x[at : at + 64, None] - y[None]) ** 2).sum(2)), 9)
        d[i[at : at + 64, None] == j[None]] = np.inf
        best = np.lexsort((np.broadcast_to(j, d.shape), d))[:, :k]
        found = pd.DataFrame({"i": np.repeat(i[at : at + 64], best.shape[1]), "j": j[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()})
        yield found[np.isfinite(found.distance)]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def probes_needed(points: DataFrame, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many cells SAMPLE points (by hash) must look into to find the share `recall` of their true neighbours among all points."""
    sample = points.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(SAMPLE).select("id", "v").collect()
    asked = np.array([r.id for r in sample])
    x = np.array([r.v for r in sample], float)
    size = (centres**2).sum(1)

    def order(v: np.ndarray) -> np.ndarray:
        return np.argsort(size - 2 * v @ centres.T, axis=1, kind="stable")

    place = np.argsort(order(x), axis=1)  # of each cell in a sampled point's order

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = pd.Series(np.arange(len(asked)), asked)
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                y, j = np.array(part["v"].tolist(), float), part["id"].to_numpy()
                home = pd.Series(order(y)[:, 0], j)
                for found in _nearest(x, asked, y, j, k):
                    yield found.assign(place=place[number[found.i].to_numpy(), home[found.j].to_numpy()])

    found = _ranked(points.select("id", "v").mapInPandas(compared, "i long, j long, distance double, place long"), k)
    places = sorted((r.place, r["count"]) for r in found.groupBy("place").count().collect())  # MAX_PIVOTS rows at most
    upto = np.cumsum([n for _, n in places])
    return places[int(np.searchsorted(upto, recall * upto[-1]))][0] + 1 if places else 1


def _far(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of points from pivots, and what rounding may add to or take off each."""
    size, own = (centres**2).sum(1), (v**2).sum(1)[:, None]
    return np.sqrt(np.maximum(size - 2 * v @ centres.T + own, 0)), 1e-6 * (np.sqrt(size) + np.sqrt(own))


def _reaches(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The largest distance of a cell's points from its pivot, for each pivot."""

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for v, home in zip(frame["v"], frame["home"], strict=True):
                cell = np.frombuffer(home, np.int32)
                far, more = (x[np.arange(len(cell)), cell] for x in _far(np.frombuffer(v).reshape(len(cell), -1), centres))
                yield pd.DataFrame({"cell": cell, "reach": far + more}).groupby("cell", as_index=False).max()

    out = np.full(len(centres), -np.inf)
    for r in rows.select("v", "home").mapInPandas(reach, "cell long, reach double").groupBy("cell").agg(F.max("reach").alias("reach")).collect():  # MAX_PIVOTS rows at most
        out[r.cell] = r.reach
    return out


def knn_indexed(points: DataFrame, k: int = 15, cell: int = CELL, probes: int | None = None, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """(i, j, rank, distance) as from neighbors.knn, of the points that stand in the nearest `probes` cells. points: id (long), v.

    The pivots are a bounded sample; every point is stored in the cell of its nearest pivot and looks into `probes` cells: as many as
    a sample of points needs to find the share RECALL of their true neighbours, if not given. With as many probes as pivots the result is exact,
    and with `exact`, where a point looks into further cells, too, unless the distance of their pivot and their reach tell that they hold none of its nearest.
    A task holds a block of looking points and a chunk of stored ones (see blockwise), whatever the size of a cell. What is compared grows with points times probes
    times points of a cell; cells grow beyond MAX_PIVOTS * cell points.
    A point gets fewer than k neighbours if its cells hold fewer; an empty table gives an empty result. Ids are distinct; vectors have one length and no nulls.
    """
    own = points.select("id", F.col("v").cast("array<double>").alias("v"))
    centres = pivots(own, cell)
    if not len(centres):
        return own.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("distance"))
    size = (centres**2).sum(1)
    order = lambda v: np.argsort(size - 2 * v @ centres.T, axis=1, kind="stable")
    asked = min(len(centres), probes or probes_needed(own, centres, k))
    rows = blockwise.packed(own, block, lambda v: order(v)[:, 0])
    reach = _reaches(rows, centres) if exact else None

    def look(b: blockwise.Block) -> None:
        near = np.zeros((len(centres), len(b.ids)), bool)
        np.put_along_axis(near, order(b.x)[:, :asked].T, True, axis=0)
        b.cells(near)
        if exact and asked < len(centres):
            far, more = _far(b.x, centres)
            b.cells(~near & ~(far - more - reach > b.d[:, -1:] + 1e-9).T)

    found = blockwise.nearest(rows, rows, k, own=True, look=look)
    forget(rows)
    return found


def nearest(points: DataFrame, k: int = 15, exact: int | None = None) -> DataFrame:
    """(i, j, rank, distance): exact neighbours of up to `exact` points (EXACT if None), else those of the index."""
    return knn(points, k) if points.count() <= (EXACT if exact is None else exact) else knn_indexed(points, k)
