"""BPE encoding and decoding by speculation and verification (operator 9).

A pretoken's tokens are proposed by greedy longest match. A sequence of tokens is the result of merging
if and only if no merge would ever have crossed a boundary between two neighbours, so every adjacent
pair of all proposals is checked at once, on arrays; only the words with a failing pair are merged exactly.

The ids are those of the public tokenizers library for a byte-level BPE file: special tokens in a text are
found first, then the text is split into pretokens. Ids are held as little-endian unsigned 32-bit integers.

Defined cases: null and empty texts have no ids and decode to ""; every row is encoded by itself, so repeated
rows repeat; very long texts are encoded whole, as a piece of their own; a null doc_id stays null; an empty table gives an empty result; ids that are not valid UTF-8 together decode with U+FFFD,
as the library does; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.llm import textbuf
from cytoplan.llm.pretokens import Encoder, Vocabulary


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    v = vocabulary(path)
    return Encoder(v.special, lambda words: encode_words(v, words))


def greedy(v: Vocabulary, word: bytes) -> list[int]:
    out, at, n, ids = [], 0, len(word), v.ids
    while at < n:
        end = min(n, at + v.longest)
        while (token := ids.get(word[at:end])) is None:
            end -= 1
        out.append(token)
        at = end
    return out


def compatible(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether no merge crosses the boundary of each pair of tokens.

    The merges inside both tokens are undone, the latest first. In between, the pieces at the boundary
    stand side by side until the next of them is merged into its token; they would merge with each other
    if their own merge comes before that. Of merges of one rank the leftmost comes first.
    """
    ok = np.ones(len(left), bool)
    live, a, b = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
    until = np.full(len(left), 1 << 62)
    while len(live):
        key = a << 32 | b
        at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        merged = (v.pair_keys[at] == key) & (v.pair_ranks[at] < until)
        ok[live[merged]] = False
        ra, rb = v.rank[a], v.rank[b]
        undo_a = ra > rb
        until = np.where(undo_a, ra, rb + 1)
        a, b = np.where(undo_a, v.right[a], a), np.where(undo_a, b, v.left[b])
        on = ~merged & (np.maximum(ra, rb) > 0)
        live, a, b, until = live[on], a[on], b[on], until[on]
    return ok


def merge(v: Vocabulary, word: bytes) -> list[int]:
    """Exact merging: a heap of candidate pairs over a linked list, n log n in the length."""
    ids = [v.ids[word[i : i + 1]] for i in range(len(word))]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*v.merges[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in v.merges]
    heap = [(rank, i, made, a, b) for rank, made, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, made, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = made, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := (made, ids[k])) in v.merges:
                rank, new = v.merges[p]
                heapq.heappush(heap, (rank, i, new, *p))
        if (h := before[i]) >= 0 and (p := (ids[h], made)) in v.merges:
            rank, new = v.merges[p]
            heapq.heappush(heap, (rank, h, new, *p))
    return [x for x in ids if x >= 0]


def encode_words(v: Vocabulary, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    proposed = [greedy(v, w) for w in raw]
    counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
    flat = np.fromiter((x for p in proposed for x in p), np.int64, int(counts.sum()))
    word = np.repeat(np.arange(len(raw)), counts)
    inner = np.flatnonzero(word[1:] == word[:-1])
    pairs, of = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
    fails = inner[~compatible(v, pairs >> 32, pairs & 0xFFFFFFFF)[of]]
    if not len(fails):
        return flat, counts
    for w in np.unique(word[fails]).tolist():
        proposed[w] = merge(v, raw[w])
        counts[w] = len(proposed[w])
    return np.fromiter((x for p in proposed for x in p), np.int64, int(counts.sum())), counts


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow array; bounds in bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for batch in batches:
        for piece in textbuf.pieces(batch.column(1)):
            ids, starts = coder.encode(piece)
            n = pa.array(np.diff(starts))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), n, _binary(np.ascontiguousarray(ids, "<u4"), starts * 4)], names=["doc_id", "n_tokens", "ids"])


def encode(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (binary, 4 bytes each) of every row."""
    path = tokenizer or default_tokenizer()
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(lambda b: _encoded(b, path), "doc_id long, n_tokens long, ids binary")


def decode_text(v: Vocabulary, ids: np.ndarray) -> str:
    return v.text_bytes(ids.astype(np.int64)).tobytes().decode("utf-8", "replace")


def _decoded(batches: Iterator[pa.RecordBatch], path: str, slab: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    length = np.diff(v.token_starts)
    for batch in batches:
        rows = batch.column(2)
        sizes = np.array([0 if r is None else r for r in pc.binary_length(rows).to_pylist()], np.int64) if len(rows) else []
        at = 0
        while at < len(rows):
            to, total = at, 0
            while to < len(rows) and (to == at or total + sizes[to] <= 4 * slab):
                total, to = total + sizes[to], to + 1
            part = batch.slice(at, to - at)
            ids = np.frombuffer(b"".join(x or b"" for x in part.column(2).to_pylist()), "<u4").astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(length[ids])))[np.concatenate(([0], np.cumsum(sizes[at:to] // 4)))]
            data = v.text_bytes(ids).tobytes()
            e = ends.tolist()
            text = pa.array([data[x:y].decode("utf-8", "replace") for x, y in zip(e[:-1], e[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, text], names=["doc_id", "n_tokens", "ids", "text"])
            at = to


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows of encode() with the text that their ids decode to."""
    path = tokenizer or default_tokenizer()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(lambda b: _decoded(b, path), "doc_id long, n_tokens long, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
