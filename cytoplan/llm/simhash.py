"""SimHash near-duplicate detection with vantage-point trees (operator 7).

1. Fingerprints: 64 bits by majority over the XXH64 values of a text's word shingles. Texts of equal
   fingerprint become one point, by a grouped minimum.
2. Shards: fingerprints are cut into BLOCKS parts. Two fingerprints within MAX_BITS differ in at most that
   many parts, so they agree in at least BLOCKS - MAX_BITS; each point goes to one shard for every
   choice of that many parts: balls of radius zero in the Hamming distance of these parts, so no shard overlaps another's boundary.
3. A shard of more than SHARD points is split by the Hamming distance from a vantage point of its own into bands of BAND bits;
   a point within MAX_BITS below a band's lower boundary is sent to that band, too, so that any two points within MAX_BITS meet. This
   is repeated, each time from other vantage points, while shards are too large, as joins and grouped counts.
4. Search: a shard is a vantage-point tree: points nearer to a vantage point than the median go to one branch, the others to
   the other. A query for what lies within MAX_BITS leaves out a branch when the triangle bound rules it out. Points that are
   linked leave the search, so a dense group of copies costs one search for each point and gives a spanning tree of
   its links, never all of its pairs.
5. Components of the links, then the class of every text by a join on the fingerprint; the most frequent fingerprints are joined
   by a broadcast of at most HOT_KEYS rows.

Shards by distance from vantage points alone would hardly prune: distances of unlike fingerprints are 32 bits and some four bits either
side, so a band of MAX_BITS around a median holds most points (README).

Defined cases: a text without words (null or blank) has the fingerprint zero and links like any other;
ties of the majority give 0; repeated rows of a doc_id are rows like any others; rows of a null doc_id get the smallest doc_id of their
component, null if there is none; very long texts are hashed whole, as a piece of their own; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cytoplan.llm import textbuf
from cytoplan.llm.common import join_with_hot_keys, written
from cytoplan.llm.components import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Parts of a fingerprint (11, 11, 11, 11, 10 and 10 bits); points share a shard when two parts agree.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Points of a leaf; points beyond which a shard is split; width of a band of distances, at least MAX_BITS; splits at most.
LEAF, SHARD, BAND, SPLITS = 128, 8192, 8, 6


def shingle_hashes(piece: textbuf.Piece, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles of a piece, row after row, and how many each row has."""
    lower = np.frombuffer(piece.data.tobytes().lower(), np.uint8)  # of bytes: changes A-Z alone
    piece.data = lower
    starts, ends, first = textbuf.words(piece)
    n = np.diff(first)
    # Words one space apart, so that every shingle is one slice.
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(at[-1], 32, np.uint8)
    if len(starts):
        joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = lower[
            np.arange(size.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        ]
    text = joined.tobytes()
    many = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(n.dtype))  # shingles of each row
    row = np.repeat(np.arange(len(n)), many)
    w = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    last = w + np.minimum(shingle, n[row]) - 1
    hashes = np.fromiter(
        (xxh64_intdigest(text[a:b], SEED) for a, b in zip(at[w].tolist(), (at[last + 1] - 1).tolist(), strict=True)),
        np.uint64, len(w),
    )
    return hashes, many


def prints_of(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The fingerprint of every row."""
    prints = np.zeros(len(many), np.uint64)
    has = np.flatnonzero(many)
    if len(has):
        begin = (np.cumsum(many) - many)[has]
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), begin)
            prints[has] |= (2 * ones > many[has].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return prints


def _fingerprints_of(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for piece in textbuf.pieces(batch.column(1)):
            prints = prints_of(*shingle_hashes(piece, shingle))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(piece.first, len(piece)), pa.array(prints.view(np.int64))], names=["doc_id", "fp"]
            )


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: _fingerprints_of(batches, shingle), "doc_id long, fp long"
    )


class Tree:
    """A vantage-point tree of distinct fingerprints; `free` says which of them a query may still find."""

    def __init__(self, points: np.ndarray, free: np.ndarray, max_bits: int):
        self.points, self.free, self.max_bits = points, free, max_bits
        self.root = self._node(np.flatnonzero(free))

    def _node(self, which: np.ndarray):
        """A leaf's places, or (vantage point, radius, inner branch, outer branch)."""
        if len(which) <= LEAF:
            return which
        own = self.points[which]
        far = own[int(np.bitwise_count(own ^ own[0]).argmax())]  # a point at the edge spreads distances most
        d = np.bitwise_count(own ^ far)
        radius = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        inner = d <= radius
        if inner.all():
            radius -= 1
            inner = d <= radius
        return int(far), radius, self._node(which[inner]), self._node(which[~inner])

    def near(self, place: int) -> np.ndarray:
        """Places of the free points within max_bits of the point at `place`."""
        x, todo, found = int(self.points[place]), [self.root], []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                vantage, radius, inner, outer = node
                d = (vantage ^ x).bit_count()
                if d - self.max_bits <= radius:
                    todo.append(inner)
                if d + self.max_bits > radius:
                    todo.append(outer)
            elif len(node):
                node = node[self.free[node]]
                found.append(node[np.bitwise_count(self.points[node] ^ self.points[place]) <= self.max_bits])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _tree_links(points: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of all pairs within max_bits. points: distinct, unsigned."""
    left, right = [], []
    if len(points) <= 32:  # compare all
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= max_bits
        a, b = np.nonzero(np.triu(near, 1))
        return points[a].tolist(), points[b].tolist()
    free = np.ones(len(points), bool)  # not yet linked
    tree, held = Tree(points, free, max_bits), len(points)
    for root in range(len(points)):
        if not free[root]:
            continue
        free[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            near = tree.near(x)
            free[near] = False
            todo += near.tolist()
            left += [int(points[x])] * len(near)
            right += points[near].tolist()
            if len(near) and 2 * (rest := int(free.sum())) < held:
                tree, held = Tree(points, free, max_bits), rest
    return left, right


def _shard_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard. A shard is held as 8 bytes a point."""
    left: list[int] = []
    right: list[int] = []
    rest_key, rest = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def search(key: np.ndarray, fp: np.ndarray) -> None:
        cut = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        size = end - begin
        two = begin[size == 2]  # most of the shards with more than one point
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
        left.extend(fp[two][near].tolist())
        right.extend(fp[two + 1][near].tolist())
        for a, b in zip(begin[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            x, y = _tree_links(fp[a:b], max_bits)
            left.extend(x)
            right.extend(y)

    for batch in batches:
        key = np.concatenate((rest_key, batch.column(0).to_numpy()))
        fp = np.concatenate((rest, batch.column(1).to_numpy().view(np.uint64)))
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))  # the last shard may go on
        if last:
            search(key[:last], fp[:last])
        rest_key, rest = key[last:], fp[last:]
        if left:
            yield _pairs(left, right)
            left.clear(), right.clear()
    if len(rest_key):
        search(rest_key, rest)
    if left:
        yield _pairs(left, right)


def _pairs(left: list[int], right: list[int]) -> pa.RecordBatch:
    a, b = np.array(left, np.uint64).view(np.int64), np.array(right, np.uint64).view(np.int64)
    return pa.RecordBatch.from_pandas(pd.DataFrame({"a": a, "b": b}), preserve_index=False)


def split_large(shards: DataFrame, max_bits: int, most: int = SHARD, band: int = BAND) -> DataFrame:
    """(shard, fp) with shards of more than `most` points split by distance from a vantage point, into overlapping bands.

    A shard that stays too large after SPLITS splits (points that lie about equally far from each other) is searched as it is.
    """
    if band < max_bits:
        raise ValueError("a band must be as wide as the distance searched for")
    for level in range(SPLITS):
        large = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max_by("fp", F.xxhash64("fp", F.lit(level))).alias("vantage")).where(F.col("n") > most)
        large = written(large.select("shard", "vantage"), "large-shards")
        if large.isEmpty():
            break
        both = shards.join(large, "shard", "left")
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        home = F.floor(d / band)
        bands = F.when(d % band >= band - max_bits, F.array(home, home + 1)).otherwise(F.array(home))
        keys = F.when(F.col("vantage").isNull(), F.array("shard")).otherwise(F.transform(bands, lambda b: F.xxhash64("shard", F.lit(level), b)))
        shards = written(both.select(F.explode(keys).alias("shard"), "fp").distinct(), "shards")
    return shards


def links(points: DataFrame, max_bits: int = MAX_BITS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect whatever lies within max_bits.

    points: one column fp of distinct fingerprints.
    """
    agree = len(blocks) - max_bits
    if agree < 1:
        raise ValueError("there must be more blocks than bits that may differ")
    begin = [sum(blocks[:i]) for i in range(len(blocks))]
    part = lambda i: F.shiftrightunsigned("fp", begin[i]).bitwiseAND(F.lit((1 << blocks[i]) - 1))
    keys = []
    for k, chosen in enumerate(combinations(range(len(blocks)), agree)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, blocks[i]).bitwiseOR(part(i))
        keys.append(key)
    shards = split_large(points.select(F.explode(F.array(*keys)).alias("shard"), "fp"), max_bits)
    shards = shards.repartition("shard").sortWithinPartitions("shard", "fp")
    return shards.mapInArrow(lambda b: _shard_links(b, max_bits), "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that can be reached) of every row."""
    prints = written(fingerprints(documents, shingle), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "points")
    linked = components(links(points.select("fp"), max_bits))
    smallest = (
        linked.join(points, linked.vertex == points.fp)
        .groupBy("root")
        .agg(F.min("first").alias("least"))
    )
    # A root is no vertex of its own table.
    of_roots = linked.select("root").distinct().join(points, F.col("root") == points.fp).select("root", "first")
    smallest = smallest.join(of_roots, "root").select("root", F.least("least", "first").alias("least"))
    classes = linked.select(F.col("vertex").alias("fp"), "root").union(
        of_roots.select(F.col("root").alias("fp"), "root")
    ).join(smallest, "root").select("fp", "least")
    by_print = written(points.join(classes, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "rows"), "classes")
    return join_with_hot_keys(prints, by_print, ["fp"], "rows").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
