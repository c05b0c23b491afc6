"""Removes repeated word spans: suffix automata of reference shards (operator 2).

A window is ``WINDOW`` consecutive words. A word goes if a window over it stands earlier too (smaller doc_id, or
earlier in the same document). Equal windows are brought together without comparing all text with all text:

1. Anchors. Of the ANCHOR-word spans of a window the one of least hash is its anchor; neighbouring windows
   mostly share it. Such a run of windows is a snippet. Equal windows have equal anchors, so the
   snippets of one anchor are all that have to be compared. A task sends on the earliest of equal snippets and
   decides the later ones itself, so copies are combined before the shuffle.
2. Equal snippets. Snippets are dealt by anchor and sorted; all but the earliest of equal ones are later copies as a whole, and an anchor with
   one snippet alone is done with. Of the BUSY_MOST anchors that stand most often, found by a pass that counts what repeats within a task's piece, snippets
   are dealt by anchor and content instead, so that none of them is one task's work.
3. Reference shards. Where an anchor has different snippets, these overlap in part. Their words are fetched, and
   each anchor's snippets are streamed, earliest first, through the suffix automaton of those before: wherever
   the matching statistic reaches WINDOW the window stands earlier. A snippet that brings new windows
   extends the automaton.
4. Anchors of more than HOT snippets would make one task's automaton too large. Their snippets are cut into windows, which spread over
   all tasks by their hashes (128 bits): the earliest of equal windows is a grouped minimum.
5. The spans of all later copies of a document are joined to its text and their words removed.

An automaton of the whole corpus would have to be broadcast and grows with it (README); a shard's automaton holds at most HOT
snippets of one anchor, and every document is streamed past only the shards that it has anchors in.

Words are known by 64-bit hashes, the long ones by XXH64; runs of words by hashes of their halves, never by sums over the run.

Defined cases: null texts have no words; repeated rows of a doc_id count as documents in the order of their texts; a null
doc_id comes first; texts of fewer than WINDOW words stay whole; very long texts are read whole, as a piece of their own; an empty table gives an empty result; columns other than
doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.llm import textbuf
from cytoplan.llm.common import join_with_hot_keys, with_copy_numbers, written

WINDOW, ANCHOR = 20, 8
#: Different snippets of an anchor that one automaton takes.
HOT = 2000
#: Rows that make an anchor busy, rows of a piece that are counted for it, and busy anchors at most.
BUSY, BUSY_LOCAL, BUSY_MOST = 1000, 8, 1000
NO_ID = -(1 << 63)  # stands for a null doc_id
_TYPES = {"long": pa.int64(), "int": pa.int32()}


def _schema(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in text.split(", ")]


SNIPPETS = "kind int, a long, s long, id long, copy int, low long, n int"
FOUND = "kind int, a long, id long, copy int, low long, n int"
FETCHED = "a long, id long, copy int, low long, words binary, w1 long, w2 long"
FETCHED_NAMES = [x.split()[0] for x in FETCHED.split(", ")]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    fields = _schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def snippets_of(h: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """row, low, n, a and s of the snippets: n windows from word low on (of all words) with anchor a; s: hash of the words."""
    runs = textbuf.Runs(h)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.arange(max(0, len(h) - window + 1))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    spans = runs.of(np.arange(len(h) - anchor + 1), np.arange(anchor, len(h) + 1))
    at = starts + np.lib.stride_tricks.sliding_window_view(spans, window - anchor + 1)[: len(starts)].argmin(1)
    fits = row[starts] == row[starts + window - 1]
    starts, at = starts[fits], at[fits]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[starts[1:]] != row[starts[:-1]])))
    begin = np.flatnonzero(new)
    low, n = starts[begin], np.diff(np.concatenate((begin, [len(starts)])))
    return row[low], low, n, _signed(spans[at[begin]]), _signed(runs.of(low, low + n + window - 1))


def _combined(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """a, s, id, copy, low and n of the snippets of each piece, sorted, and whether an equal one stands earlier in the piece."""
    for batch in batches:
        for piece in textbuf.pieces(batch.column(2), 1 << 22):
            starts, ends, first = textbuf.words(piece)
            row, low, n, a, s = snippets_of(textbuf.word_hashes(piece, starts, ends), first, window, anchor)
            ids = batch.column(0).slice(piece.first, len(piece)).to_numpy()[row]
            copies = batch.column(1).slice(piece.first, len(piece)).to_numpy()[row]
            low = low - first[:-1][row]
            order = np.lexsort((low, copies, ids, s, a))
            ids, copies, low, n, a, s = (x[order] for x in (ids, copies, low, n, a, s))
            later = np.zeros(len(a), bool)
            later[1:] = (a[1:] == a[:-1]) & (s[1:] == s[:-1])
            yield a, s, ids, copies, low, n.astype(np.int32), later


def _counted(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for a, *_, later in _combined(batches, window, anchor):
        own, n = np.unique(a[~later], return_counts=True)
        yield _batch("a long, n long", own[n >= BUSY_LOCAL], n[n >= BUSY_LOCAL])


def busy_anchors(docs: DataFrame, window: int, anchor: int) -> np.ndarray:
    found = docs.mapInArrow(lambda b: _counted(b, window, anchor), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") > BUSY).orderBy(F.desc("n"), "a").limit(BUSY_MOST).collect()
    return np.array([r.a for r in rows], np.int64)


def _snippets(batches: Iterator[pa.RecordBatch], window: int, anchor: int, busy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """kind 0: to be compared with its anchor's others, 1: a later copy, 2: of a busy anchor."""
    for a, s, ids, copies, low, n, later in _combined(batches, window, anchor):
        kind = np.where(later, 1, np.where(np.isin(a, busy), 2, 0)).astype(np.int32)
        yield _batch(SNIPPETS, kind, a, s, ids, copies, low, n)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by a, s and place. kind out: 0 later copies, 1: firsts of equal snippets, of anchors that have several.

    The first snippet of an anchor waits until another of it is met.
    """
    last, last_anchor, waiting = None, None, None
    for batch in batches:
        if not len(batch):
            continue
        columns = [c.to_numpy() for c in batch.columns]
        kind, a, s = columns[:3]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        new[0] = last != (a[0], s[0])
        last = (a[-1], s[-1])
        ask = new & (kind == 2)
        at = np.flatnonzero(new & (kind == 0))
        if len(at):
            again = np.ones(len(at), bool)
            again[1:] = a[at[1:]] == a[at[:-1]]
            again[0] = last_anchor == a[at[0]]
            if again[0] and waiting is not None:
                yield _batch(FOUND, [1], *([x] for x in waiting))
                waiting = None
            ask[at] = again
            ask[at[:-1]] |= again[1:]
            last_anchor = a[at[-1]]
            waiting = None if again[-1] else tuple(columns[c][at[-1]] for c in (1, 3, 4, 5, 6))
        out = np.flatnonzero(ask | ~new | (kind == 1))
        yield _batch(FOUND, ask[out].astype(np.int32), *(columns[c][out] for c in (1, 3, 4, 5, 6)))


class Automaton:
    """Suffix automaton (Blumer et al. 1985) of several sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:  # of an earlier sequence
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
                continue
            p, last = last, self._state(self.size[last] + 1, 0, {})
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)

    def matching(self, sequence: list[int]) -> list[int]:
        """For each end: the length of the longest suffix that stands in the automaton."""
        out, state, size = [], 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            out.append(size)
        return out


def _fetched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """id, copy, text, asks (a, low, n, hot) -> the words of each snippet, as hashes, or its windows, if it is hot."""
    for batch in batches:
        asks = batch.column(3)
        for piece in textbuf.pieces(batch.column(2)):
            starts, ends, first = textbuf.words(piece)
            h = textbuf.word_hashes(piece, starts, ends)
            part = asks.slice(piece.first, len(piece))
            flat = part.flatten()
            a, low, n, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            row = np.repeat(np.arange(len(piece)), np.diff(part.offsets.to_numpy()))
            ids, copies = (batch.column(k).slice(piece.first, len(piece)).to_numpy() for k in (0, 1))
            cold = np.flatnonzero(~hot)
            begin = first[:-1][row[cold]] + low[cold]
            words = [h[x:y].tobytes() for x, y in zip(begin.tolist(), (begin + n[cold] + window - 1).tolist(), strict=True)]
            none = pa.nulls(len(cold), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a[cold]), pa.array(ids[row[cold]]), pa.array(copies[row[cold]], pa.int32()), pa.array(low[cold]), pa.array(words, pa.binary()), none, none], names=FETCHED_NAMES)
            if hot.any():
                which = np.repeat(np.flatnonzero(hot), n[hot])
                at = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                begin = first[:-1][row[which]] + at
                one, two = textbuf.Runs(h).of(begin, begin + window), textbuf.Runs(textbuf.mix(~h)).of(begin, begin + window)
                yield pa.RecordBatch.from_arrays([pa.array(a[which]), pa.array(ids[row[which]]), pa.array(copies[row[which]], pa.int32()), pa.array(at), pa.nulls(len(which), pa.binary()), pa.array(_signed(one)), pa.array(_signed(two))], names=FETCHED_NAMES)


def _streamed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and place; every anchor is a shard with an automaton."""
    anchor, shard = None, Automaton()
    for batch in batches:
        kept: list[tuple[int, int, int, int, int]] = []
        for a, i, copy, low, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sequence = np.frombuffer(words, np.uint64).tolist()
            if a != anchor:
                anchor, shard = a, Automaton()
                shard.add(sequence)
                continue
            fresh = False
            for end, size in enumerate(shard.matching(sequence)):
                if end >= window - 1:
                    if size >= window:
                        kept.append((a, i, copy, low + end - window + 1, 1))
                    else:
                        fresh = True
            if fresh:
                shard.add(sequence)
        if kept:
            yield _batch(FOUND, [0] * len(kept), *zip(*kept, strict=True))


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans (low, n) -> counts and what is kept."""
    for batch in batches:
        spans = batch.column(2)
        for piece in textbuf.pieces(batch.column(1)):
            starts, ends, first = textbuf.words(piece)
            part = spans.slice(piece.first, len(piece))
            flat = part.flatten()
            low, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            sizes = np.array([0 if x is None else len(x) for x in part]) if part.null_count else np.diff(part.offsets.to_numpy())
            row = np.repeat(np.arange(len(piece)), sizes)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, first[:-1][row] + low, 1)
            np.add.at(change, first[:-1][row] + low + n + window - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            data = piece.data.tobytes()
            kept = [data[x:y] for x, y in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]
            left = np.concatenate(([0], np.cumsum(~gone)))[first].tolist()
            text = [b" ".join(kept[x:y]).decode() for x, y in zip(left[:-1], left[1:], strict=True)]
            total = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(piece.first, len(piece)), pa.array(total), pa.array(total - np.diff(left)), pa.array(text, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


def dedup(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row."""
    docs = with_copy_numbers(documents).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("copy").cast("int"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    )
    texts = docs.select("id", "copy", "text")
    busy = busy_anchors(texts, window, anchor)
    snippets = texts.mapInArrow(lambda b: _snippets(b, window, anchor, busy), SNIPPETS)
    # Rows decided already may go to any task; the snippets of a busy anchor go by their content.
    key = F.when(F.col("kind") == 0, F.col("a")).when(F.col("kind") == 1, F.xxhash64("id", "low")).otherwise(F.xxhash64("a", "s"))
    own = F.when(F.col("kind") == 1, key).otherwise(F.col("a"))
    dealt = snippets.withColumn("key", key).withColumn("a", own).repartition("key").drop("key").sortWithinPartitions("a", "s", "id", "copy", "low")
    found = written(dealt.mapInArrow(_firsts, FOUND), "found")
    firsts = found.where("kind = 1").select("a", "id", "copy", "low", "n")
    several = firsts.groupBy("a").agg(F.count(F.lit(1)).alias("many")).select("a", (F.col("many") > hot).alias("hot"))
    asks = firsts.join(several, "a").groupBy("id", "copy").agg(F.collect_list(F.struct("a", "low", "n", "hot")).alias("asks"))
    with_text = docs.join(asks, ["id", "copy"]).select("id", "copy", "text", "asks")
    words = written(with_text.mapInArrow(lambda b: _fetched(b, window), FETCHED), "words")
    shards = words.where("words is not null").select("a", "id", "copy", "low", "words").repartition("a").sortWithinPartitions("a", "id", "copy", "low")
    more = shards.mapInArrow(lambda b: _streamed(b, window), FOUND)
    windows = words.where("words is null").select("w1", "w2", "id", "copy", "low")
    place = F.struct("id", "copy", "low")
    earliest = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = join_with_hot_keys(windows, earliest, ["w1", "w2"], "rows").where(F.col("first") != place).select("id", "copy", "low", F.lit(1).alias("n"))
    later = found.where("kind = 0").select("id", "copy", "low", "n").unionByName(written(more.select("id", "copy", "low", "n").unionByName(again), "matched"))
    spans = later.groupBy("id", "copy").agg(F.collect_list(F.struct("low", "n")).alias("spans"))
    rows = docs.join(spans, ["id", "copy"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<low:bigint,n:int>>")).alias("spans"))
    return rows.mapInArrow(lambda b: _removed(b, window), "doc_id long, n_words long, n_removed long, kept string")


def digests(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
