"""Benchmark decontamination by pigeonhole edit matching (operator 10).

Texts and items are compared as word sequences, ASCII lower-cased, with ASCII punctuation as white space. An item of m
words may differ in ``errors(m)`` words (insertions, deletions, replacements). It is split into one piece
more than that; if some passage of a text is within the budget, at least one piece stands in it unchanged. All piece
hits are found by hashes on arrays; around each, Myers' bit-parallel algorithm gives the distance of the item to the
best passage. Items are a stated query set: equal ones are taken once, in blocks of bounded count and bytes, each broadcast for one pass over the texts (an item longer
than a block is one by itself).

Result: a row for each text and item within the budget, with its distance and the word where the passage ends.

Defined cases: null and empty texts match nothing; items without words are left out; repeated item ids are
separate items, of which the best match counts; repeated rows of a doc_id, null included, are one text each, of which the best match
counts (where documents are dropped, each row goes by its own text); of passages at the best distance the first counts; very long texts are read whole, as a piece of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from cytoplan.llm import textbuf

#: Share of an item's words that may differ, for a similarity of 0.8.
ERROR_SHARE = 0.2
#: Bounds on one broadcast block, and times these from which a block is dealt anew.
BLOCK_ITEMS, BLOCK_BYTES, OVER = 20_000, 1 << 24, 2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
for _a, _b in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    _FOLD[_a : _b + 1] = 0x20


def errors(m: int) -> int:
    return int(ERROR_SHARE * m + 1e-9)


def folded(piece: textbuf.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a piece, and the first word of each row, with the end."""
    piece.data = _FOLD[piece.data]
    starts, ends, first = textbuf.words(piece)
    return textbuf.word_hashes(piece, starts, ends), first


def best_end(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of item to any passage of text, and one past where the first such ends.

    Myers (1999): the vertical differences of a column of the distance matrix as two bit vectors.
    """
    m = len(item)
    all_ones, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    plus, minus, now, best, at = all_ones, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = places.get(w, 0)
        level = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (all_ones & ~(level | plus)), plus & level
        now += bool(up & top) - bool(down & top)
        up, down = (up << 1) & all_ones, (down << 1) & all_ones  # a passage may begin anywhere
        diagonal = eq | minus
        plus, minus = down | (all_ones & ~(diagonal | up)), up & diagonal
        if now < best:
            best, at = now, j
    return best, at


class Block:
    """Some items by their keys, with their pieces by length."""

    def __init__(self, ids: list[bytes], texts: list[str]):
        self.ids, self.items = [], []
        base = 0
        for piece in textbuf.pieces(pa.array(texts, pa.string())):
            h, first = folded(piece)
            for r in range(len(piece)):
                if first[r + 1] > first[r]:
                    self.ids.append(ids[base + piece.first + r])
                    self.items.append(h[first[r] : first[r + 1]])
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for k, h in enumerate(self.items):
            runs = textbuf.Runs(h)
            cuts = np.linspace(0, len(h), errors(len(h)) + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                span = runs.of(np.array([a]), np.array([b]))[0]
                pieces.setdefault(int(b - a), []).append((int(span), k, int(a)))
        self.pieces = {}
        for size, found in pieces.items():
            found.sort()
            self.pieces[size] = (np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found]), np.array([x[2] for x in found]))

    def matches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, end) for the best passage of every item within its budget in each row."""
        runs = textbuf.Runs(h)
        hits = []
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size, (keys, item, offset) in self.pieces.items():
            at = np.arange(max(0, len(h) - size + 1))
            at = at[row_of[at] == row_of[at + size - 1]]
            span = runs.of(at, at + size)
            low, high = np.searchsorted(keys, span, "left"), np.searchsorted(keys, span, "right")
            some = np.flatnonzero(high > low)
            n = (high - low)[some]
            which = np.repeat(low[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(at[some], n)
            hits.append(np.stack((row_of[pos], item[which], pos - offset[which]), 1))
        if not hits:
            return []
        hits = np.concatenate(hits)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if len(hits):
            order = np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))
            stop = (-1, -1, -1)
            for row, k, start in hits[order].tolist():
                wanted = self.items[k]
                m, e = len(wanted), errors(len(wanted))
                if (row, k) == stop[:2] and start + m + e <= stop[2]:
                    continue  # looked at already
                a, b = max(int(first[row]), start - e), min(int(first[row + 1]), start + m + 3 * e + 8)
                stop = (row, k, b)
                d, end = best_end(wanted.tolist(), h[a:b].tolist())
                if d <= e and (d, a + end) < best.get((row, k), (m + 1, 0)):
                    best[row, k] = (d, a + end)
        return [(row, k, d, end - int(first[row])) for (row, k), (d, end) in best.items()]


def _matched(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in textbuf.pieces(batch.column(1)):
            h, first = folded(piece)
            found = block.matches(h, first)
            if found:
                ids = batch.column(0)
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([piece.first + r for r in cols[0]])), pa.array([block.ids[k] for k in cols[1]], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())],
                    names=["id", "item", "distance", "end_word"],
                )


def key_of(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def item_blocks(items: DataFrame) -> Iterator[Block]:
    """Different items (item, text) in blocks of a bounded count and size; the driver holds one at a time."""
    size = F.sum(F.octet_length("text"))
    n, bytes_ = items.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    todo = [(max(1, -(-n // BLOCK_ITEMS), -(-bytes_ // BLOCK_BYTES)), None)]
    while todo:
        many, within = todo.pop()
        part = F.pmod(F.xxhash64("item"), F.lit(many))
        rows = items if within is None else items.where(F.pmod(F.xxhash64("item"), F.lit(within[0])) == within[1])
        for k, count, total in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)), size).orderBy("part").collect():  # a row for each block
            if count > 1 and (count > OVER * BLOCK_ITEMS or total > OVER * BLOCK_BYTES):
                todo.append((many * 5, (many, k)))
                continue
            got = rows.where(part == k).toArrow()
            yield Block(got["item"].to_pylist(), got["text"].to_pylist())


def passages(texts: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, item, distance, end_word) of every text and different item within the item's budget; and the items: item, item_id. texts: id, text."""
    spark = texts.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), key_of(F.col("text")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"id {dict(texts.dtypes)['id']}, item binary, distance int, end_word long"
    found = []
    for block in item_blocks(items.groupBy("item").agg(F.first("text").alias("text"))):
        shared = spark.sparkContext.broadcast(block)
        found.append(texts.select("id", F.col("text").cast("string")).mapInArrow(lambda b, s=shared: _matched(b, s.value), schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema), items.select("item", "item_id")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, end_word) of every text and item within the item's budget."""
    rows, items = passages(documents.select(F.col("doc_id").cast("long").alias("id"), "text"), benchmark)
    best = rows.groupBy("id", "item").agg(F.min(F.struct("distance", "end_word")).alias("m"))
    best = best.join(items, "item").groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.min("m").alias("m"))
    return best.select("doc_id", "item_id", "m.distance", "m.end_word")


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item is found in."""
    # By the text: null and repeated doc_ids need no key of their own.
    key = key_of(documents.text)
    bad = passages(documents.select(key.alias("id"), "text"), benchmark)[0].select(F.col("id").alias("found")).distinct()
    return documents.join(bad, key == bad.found, "left_anti").select([documents[c] for c in documents.columns])
