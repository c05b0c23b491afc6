"""Near-duplicates of word-shingle Jaccard SIMILAR or more: the near-dedup stage of the pipeline.

1. Texts of equal shingle sets are one point.
2. Candidates: SimHash links (operator 7) and the buckets of BANDS bands of ROWS min-hashes each. A pair of Jaccard j shares no
   bucket with probability (1 - j ** ROWS) ** BANDS: below 8 in a million at 0.8. A bucket is linked as a star, so a large one
   costs a link for each point; all pairs of a bucket are in one component of these links.
3. Each such component goes to a task with one text for each point, where shingle sets are compared exactly: points
   that are linked leave the search, and only sizes within the ratio are compared.
4. A component of more than two blocks of points is never held by one task. First one block of it is compared with each
   of its blocks, which links most of a dense group. Then every bucket that still holds points of several classes is
   compared in blocks: the points outside its largest class with all of its points. Points of one class need no more links.
5. Components of the exact links. Of each, the row of smallest doc_id stays.

Defined cases: texts without words (null or blank) are one point that is near nothing else; a null doc_id comes last in the order; rows of
one doc_id are told apart by their copy numbers; very long texts are compared whole, and a task holds the shingle sets of two blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.llm import textbuf
from cytoplan.llm.common import join_with_hot_keys, written
from cytoplan.llm.components import components
from cytoplan.llm.simhash import links, prints_of, shingle_hashes

#: A pair is near if inter / union >= SIMILAR[0] / SIMILAR[1].
SIMILAR = (4, 5)
BANDS, ROWS = 50, 7
#: Points in a block: a task compares two of them at most.
BLOCK = 1024
_XOR, _ODD = np.random.default_rng(20240301).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets_of(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted, and how many."""
    row = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(many))


def _points_of(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in textbuf.pieces(batch.column(2)):
            hashes, many = shingle_hashes(piece, shingle)
            prints = prints_of(hashes, many)
            hashes, size = sets_of(hashes, many)
            has = np.flatnonzero(size)
            point, bands = np.zeros(len(size), np.uint64), np.zeros((len(has), BANDS), np.uint64)
            if len(has):
                begin = (np.cumsum(size) - size)[has]
                point[has] = textbuf.mix(np.add.reduceat(textbuf.mix(hashes), begin) ^ size[has].astype(np.uint64))
                for k in range(BANDS):
                    band = np.full(len(has), k + 1, np.uint64)
                    for j in range(k * ROWS, (k + 1) * ROWS):
                        band = textbuf.mix(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((hashes ^ _XOR[j]) * _ODD[j], begin))
                    bands[:, k] = band
            offsets = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))).astype(np.int32)
            rows = [batch.column(c).slice(piece.first, len(piece)) for c in (0, 1)]
            buckets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*rows, pa.array(point.view(np.int64)), pa.array(prints.view(np.int64)), buckets], names=["doc_id", "copy", "point", "fp", "bands"])


def exact_links(hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all pairs that are near. hashes: the sets, one after another, of `size` each (1 or more)."""
    ids = np.unique(hashes, return_inverse=True)[1]
    mark = np.zeros(len(hashes), bool)
    begin = np.cumsum(size) - size
    low, high = SIMILAR
    left, right = [], []
    # Those not yet linked, by size: their numbers, sizes, and sets in one array.
    rest = np.argsort(size, kind="stable")

    def gathered(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = size[which]
        to = np.cumsum(n)
        return n, np.concatenate(([0], to)), ids[np.arange(n.sum()) + np.repeat(begin[which] - (to - n), n)]

    n, at, flat = gathered(rest)
    free = np.ones(len(rest), bool)
    for root in range(len(size)):
        where = np.flatnonzero(rest == root)
        if not len(where) or not free[where[0]]:
            continue
        free[where[0]] = False
        todo = [root]
        while todo:
            x = todo.pop()
            own = ids[begin[x] : begin[x] + size[x]]
            a, b = np.searchsorted(n, -(-low * size[x] // high), "left"), np.searchsorted(n, high * size[x] // low, "right")
            if free[a:b].any():
                mark[own] = True
                inter = np.add.reduceat(mark[flat[at[a] : at[b]]], at[a:b] - at[a], dtype=np.int64)
                mark[own] = False
                near = a + np.flatnonzero(free[a:b] & ((low + high) * inter >= low * (n[a:b] + size[x])))
                free[near] = False
                left.append(np.full(len(near), x))
                right.append(rest[near])
                todo += rest[near].tolist()
            if 2 * free.sum() < len(rest):
                rest = rest[free]
                n, at, flat = gathered(rest)
                free = np.ones(len(rest), bool)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _compared(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, point, text) come sorted by task. Of a task, the shingle sets are held."""
    key, points, hashes, sizes = None, [], [], []

    def settle() -> pa.RecordBatch:
        p = np.concatenate(points)
        a, b = exact_links(np.concatenate(hashes), np.concatenate(sizes))
        return pa.RecordBatch.from_arrays([pa.array(p[a]), pa.array(p[b])], names=["a", "b"])

    for batch in batches:
        roots, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for piece in textbuf.pieces(batch.column(2)):
            h, size = sets_of(*shingle_hashes(piece, shingle))
            root, point = roots[piece.first : piece.first + len(piece)], own[piece.first : piece.first + len(piece)]
            to = np.concatenate(([0], np.cumsum(size)))
            cut = [0, *(np.flatnonzero(np.diff(root)) + 1).tolist(), len(root)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if points and root[i] != key:
                    yield settle()
                    points, hashes, sizes = [], [], []
                key = root[i]
                points.append(point[i:j])
                hashes.append(h[to[i] : to[j]])
                sizes.append(size[i:j])
    if points:
        yield settle()


def _members(linked: DataFrame) -> DataFrame:
    """(point, root) with the roots, which are no vertices of their own table."""
    return linked.select(F.col("vertex").alias("point"), "root").union(linked.select("root", "root").distinct())


def tasks_of(block: int) -> F.Column:
    """The comparisons that a point takes part in, of its columns root, point, n, query and blocks.

    A group (root) of n points, two blocks at most, is one comparison. In a larger one each of the `blocks` blocks of points with
    `query` meets each block of all points.
    """
    every = F.ceil(F.col("n") / block).cast("long")
    number = lambda seed, many: F.pmod(F.xxhash64("point", F.lit(seed)), many)
    upto = lambda many: F.sequence(F.lit(0).cast("long"), many - 1)
    held = F.transform(upto(F.col("blocks")), lambda q: F.xxhash64("root", q, number(0, every)))
    asked = F.transform(upto(every), lambda b: F.xxhash64("root", number(1, F.col("blocks")), b))
    both = F.when(F.col("query"), F.concat(held, asked)).otherwise(held)
    return F.when(F.col("n") > 2 * block, both).otherwise(F.array("root"))


def _pairs(groups: DataFrame, points: DataFrame, docs: DataFrame, shingle: int, block: int) -> DataFrame:
    """(a, b): the exact links that the groups' comparisons find."""
    texts = groups.select("point", tasks_of(block).alias("tasks")).join(points.select("point", "first.doc_id", "first.copy"), "point")
    texts = texts.join(docs, texts.doc_id.eqNullSafe(docs.doc_id) & (texts.copy == docs.copy)).select(F.explode("tasks").alias("task"), "point", docs.text)
    found = texts.repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: _compared(b, shingle), "a long, b long")
    return written(found.where("a != b"), "pairs")


def _still_apart(large: DataFrame, buckets: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """The buckets of the points of large components that hold several classes of the links so far, as groups."""
    classes = large.join(_members(components(pairs)), "point", "left").select("point", F.coalesce("root", "point").alias("class"))
    rows = written(buckets.join(classes, "point").select(F.col("bucket").alias("root"), "point", "class"), "candidates")
    sizes = rows.groupBy("root", "class").agg(F.count(F.lit(1)).alias("own"))
    most = F.max(F.struct("own", "class"))
    sizes = sizes.groupBy("root").agg(F.sum("own").alias("n"), most.alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    blocks = F.ceil((F.col("n") - F.col("most.own")) / block).cast("long")
    sizes = written(sizes.select("root", "n", F.col("most.class").alias("largest"), blocks.alias("blocks")), "mixed-buckets")
    return join_with_hot_keys(rows, sizes, ["root"], "n").withColumn("query", F.col("class") != F.col("largest"))


def first_copies(documents: DataFrame, shingle: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, copy) of the rows to keep, one of each component. documents: doc_id, copy, text. block: points of half a comparison."""
    docs = documents.select("doc_id", F.col("copy").cast("int").alias("copy"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, copy int, point long, fp long, bands array<long>"
    rows = written(docs.mapInArrow(lambda b: _points_of(b, shingle), schema), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "copy")
    points = written(rows.groupBy("point").agg(F.min(order).alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "points")
    full = points.where(F.size("bands") > 0)

    heads = full.groupBy("fp").agg(F.min("point").alias("head"))
    by_fp = full.join(heads, "fp").select("point", "head")
    near = written(links(heads.select("fp")).join(heads.toDF("a", "u"), "a").join(heads.toDF("b", "v"), "b").select("u", "v"), "near")
    buckets = full.select("point", F.explode("bands").alias("bucket"))
    of_bucket = buckets.groupBy("bucket").agg(F.min("point").alias("head"), F.max("point").alias("other")).where("head < other").select("bucket", "head")
    stars = buckets.join(of_bucket, "bucket").select("point", "head")
    maybe = written(_members(components(by_fp.union(near).union(stars))), "maybe")

    sizes = written(maybe.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    in_first = F.pmod(F.xxhash64("point", F.lit(0)), F.ceil(F.col("n") / block).cast("long")) == 0
    groups = join_with_hot_keys(maybe, sizes, ["root"], "n").withColumns({"query": in_first, "blocks": F.lit(1).cast("long")})
    pairs = _pairs(groups, points, docs, shingle, block)
    if not sizes.where(F.col("n") > 2 * block).isEmpty():
        large = groups.where(F.col("n") > 2 * block).select("point")
        every = buckets.union(by_fp).union(near)
        pairs = pairs.union(_pairs(_still_apart(large, every, pairs, block), points, docs, shingle, block))

    classes = _members(components(pairs)).join(points.select("point", "first"), "point")
    least = classes.groupBy("root").agg(F.min("first").alias("least"))
    later = classes.join(least, "root").where("first != least").select("point")
    return points.join(later, "point", "left_anti").select("first.doc_id", "first.copy")
