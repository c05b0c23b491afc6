"""Toxicity scores from subword-bag embeddings averaged into a linear softmax (operator 3).

A word's vector is the mean of the vectors of its character n-grams (with word-boundary marks) and of itself, all
hashed into ``BUCKETS`` rows; a text's vector is the weighted mean of its words', and a linear softmax gives the score. Vectors
and softmax are trained jointly in numpy, with Adam on small batches of texts, on at most ``MAX_TRAIN`` labelled texts, chosen by
a hash of doc_id. A misspelling that was never seen shares most of its n-gram vectors with the known word.

A word weighs RARE / (RARE + its share of the training words), the smooth inverse frequency of Arora et al. (2017), so that a rare word counts in
a long text; a word that training has not met weighs 1. The same words and weights count in training and in scoring: none is
left out. Both classes weigh the same in training. Then a slope and shift of the logit are fitted on every FOLD-th training text, which a
first model has not seen, by the best F1 at 0.5; the model itself is trained on all of them.

Training holds the words of the texts as hashes and one batch's n-grams at a time, so memory is bounded by a batch beside the tables.
As averages are linear, a trained model is one number for each bucket, and one for each common word; scoring streams whole texts past it.

Defined cases: null texts, empty ones and those without a word have the share of toxic labels in training as their score; rows with a null label or doc_id are not learned from;
a doc_id labelled twice counts as toxic if one label says so; with no label, or labels of one class, every score is
the share of toxic labels (0.5 if none); a null doc_id is not held out; repeated rows are scored each, and of several texts of one labelled doc_id the first
in order is learned from; very long texts are read whole, in scoring as a piece of their own; of more than MAX_TRAIN_BYTES of
training text, the texts that would go beyond are left out of training; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.llm import textbuf

BUCKETS, DIM, NGRAMS = 1 << 17, 4, (3, 4, 5)
#: Bounds on the labelled rows that are learned from, and on their text.
MAX_TRAIN, MAX_TRAIN_BYTES = 5000, 1 << 26
EPOCHS, BATCH, RATE, DECAY = 8, 250, 0.1, 0.2
RARE = 3e-4
FOLDS = 5


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: its vector times the softmax, toxic minus not
    bias: float
    empty: float = 0.5  # the score of texts without words
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes, ascending
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the training words


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all n-grams of the words, and of the words themselves."""
    size = ends - starts + 2
    to = np.cumsum(size)
    begin = to - size
    marked = np.full(int(to[-1]) if len(to) else 0, ord("<"), np.uint8)
    marked[to - 1] = ord(">")
    inner = np.arange(int((size - 2).sum()))
    low = np.cumsum(size - 2) - (size - 2)
    marked[inner + np.repeat(begin + 1 - low, size - 2)] = data[inner + np.repeat(starts - low, size - 2)]
    view = textbuf.eights(marked)
    word = np.repeat(np.arange(len(starts), dtype=np.int32), size)
    at, left = np.arange(len(marked)), np.repeat(to, size)
    whole = textbuf.Piece(0, marked, np.array([0, len(marked)]))
    whose, found = [np.arange(len(starts), dtype=np.int32)], [textbuf.word_hashes(whole, begin, to)]
    for n in NGRAMS:
        fits = at + n <= left
        whose.append(word[fits])
        found.append(textbuf.mix((view[at[fits]] & np.uint64((1 << 8 * n) - 1)) | np.uint64(n << 56)))
    return np.concatenate(whose), (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int32)


def lowered(piece: textbuf.Piece):
    """The piece in lower case, and its words as in textbuf.words()."""
    piece.data = np.frombuffer(piece.data.tobytes().lower(), np.uint8)  # of bytes: A-Z alone
    return piece, *textbuf.words(piece)


def weight_of(hashes: np.ndarray, common: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The weight of each word, by its share of the training words."""
    if not len(common):
        return np.ones(len(hashes))
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return RARE / (RARE + np.where(common[at] == hashes, share[at], 0.0))


class _Mean:
    """A sparse matrix of row means, applied to rows of vectors and, transposed, to their gradients."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int):
        order = np.argsort(row, kind="stable")
        row, self.col, value = row[order].astype(np.int32), col[order].astype(np.int32), value[order]
        total = np.bincount(row, value, rows)
        self.row, self.rows = row, rows
        self.value = (value / np.maximum(total, 1e-12)[row]).astype(np.float32)[:, None]
        self.back = np.argsort(self.col, kind="stable").astype(np.int32)

    @staticmethod
    def _sum(key: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, values.shape[1]), np.float32)
        if len(key):
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            out[key[cut]] = np.add.reduceat(values, cut)
        return out

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._sum(self.row, x[self.col] * self.value, self.rows)

    def grad(self, g: np.ndarray, size: int) -> np.ndarray:
        b = self.back
        return self._sum(self.col[b], g[self.row[b]] * self.value[b], size)


class _Batch:
    """Some texts: their words as means of buckets, and themselves as weighted means of words."""

    def __init__(self, texts: list[str], common: np.ndarray, share: np.ndarray):
        rows, hashes, word_grams, buckets, known = [], [], [], [], np.zeros(0, np.uint64)
        for piece in textbuf.pieces(pa.array(texts, pa.string())):
            _, starts, ends, first = lowered(piece)
            h = textbuf.word_hashes(piece, starts, ends)
            rows.append(piece.first + np.repeat(np.arange(len(piece)), np.diff(first)))
            hashes.append(h)
            one = np.unique(h, return_index=True)[1]
            one = one[~np.isin(h[one], known)]
            w, g = grams(piece.data, starts[one], ends[one])
            word_grams.append(h[one][w])
            buckets.append(g)
            known = np.union1d(known, h[one])
        row, word = np.concatenate(rows), np.searchsorted(known, np.concatenate(hashes))
        self.by_word = _Mean(np.searchsorted(known, np.concatenate(word_grams)), np.concatenate(buckets), np.ones(sum(map(len, buckets))), len(known))
        pair, n = np.unique(row * max(1, len(known)) + word, return_counts=True)
        row, word = np.divmod(pair, max(1, len(known)))
        self.by_text = _Mean(row, word, n * weight_of(known, common, share)[word], len(texts))


def shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words that are more than a tenth of RARE of all words, and their shares."""
    found = [np.zeros(0, np.uint64)]
    for piece in textbuf.pieces(pa.array(texts, pa.string())):
        _, starts, ends, _ = lowered(piece)
        found.append(textbuf.word_hashes(piece, starts, ends))
    words, n = np.unique(np.concatenate(found), return_counts=True)
    share = n / max(1, n.sum())
    return words[share > RARE / 10], share[share > RARE / 10]


def _descend(batches: list[_Batch], wants: list[np.ndarray], epochs: int, decay: float, seed: int) -> tuple[np.ndarray, float]:
    """Adam on the mean cross-entropy of both classes, each with half of the weight."""
    rng = np.random.default_rng(seed)
    share = min(max(float(np.concatenate(wants).mean()), 1e-6), 1 - 1e-6)
    p = [np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    order = np.concatenate([rng.permutation(len(batches)) for _ in range(epochs)])
    for step, k in enumerate(order.tolist(), 1):
        batch, toxic = batches[k], wants[k]
        words = batch.by_word.of(p[0])
        text = batch.by_text.of(words)
        z = text @ p[1] + p[2]
        q = np.exp(z - z.max(1, keepdims=True))
        weight = np.where(toxic > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        gz = (q / q.sum(1, keepdims=True) - np.stack((1 - toxic, toxic), 1)) * (weight / len(toxic))[:, None]
        g = [batch.by_word.grad(batch.by_text.grad(gz @ p[1].T, len(words)), BUCKETS), text.T @ gz, gz.sum(0)]
        rate = RATE * (1 - (step - 1) / len(order))
        for i in range(3):
            m[i] += 0.1 * (g[i] - m[i])
            v[i] += 0.01 * (g[i] ** 2 - v[i])
            if i == 0:
                p[i] *= 1 - rate * decay
            p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return (p[0] @ (p[1][:, 1] - p[1][:, 0])).astype(np.float32), float(p[2][1] - p[2][0])


def _logits(batches: list[_Batch], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.concatenate([b.by_text.of(b.by_word.of(weights[:, None]))[:, 0] + bias for b in batches])


def best_cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The logit at which taking those above as toxic has the best F1."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + toxic.sum())
    k = int(f1.argmax())
    return float(z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2


def fit(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, decay: float = DECAY, seed: int = 7) -> Model:
    share = float(toxic.mean()) if len(toxic) else 0.5
    if share in (0.0, 1.0) or len(toxic) == 0:
        return Model(np.zeros(BUCKETS, np.float32), float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -13, 13)), share)
    common, part = shares(texts)
    order = np.random.default_rng(seed).permutation(len(texts))
    size = max(16, min(BATCH, len(texts) // 20))  # few texts take as many steps as many
    size = max(1, min(size, len(texts) // FOLDS))
    chosen = [order[k : k + size] for k in range(0, len(order), size)]
    batches, wants = [_Batch([texts[i] for i in c], common, part) for c in chosen], [toxic[c].astype(np.float32) for c in chosen]
    kept, tried = [k for k in range(len(chosen)) if k % FOLDS], [k for k in range(len(chosen)) if k % FOLDS == 0]
    weights, bias = _descend([batches[k] for k in kept], [wants[k] for k in kept], epochs, decay, seed)
    cut = best_cut(_logits([batches[k] for k in tried], weights, bias), np.concatenate([wants[k] for k in tried]))
    weights, bias = _descend(batches, wants, epochs, decay, seed)
    return Model(weights, bias - cut, share, common, part)


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """Learns from at most max_train labelled rows, of at most max_bytes together, outside the held-out fold."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(*order).limit(max_train)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    fits = F.sum("size").over(Window.orderBy(*order)) <= max_bytes  # max_train rows without texts
    chosen = marks.join(F.broadcast(size.withColumn("fits", fits).where("fits").select("doc_id")), "doc_id")
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    got = rows.orderBy("doc_id").select("text", "toxic").toArrow()
    return fit(got["text"].to_pylist(), (got["toxic"].to_numpy() > 0).astype(np.float32))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in textbuf.pieces(batch.column(1)):
            _, starts, ends, first = lowered(piece)
            h, one, place = np.unique(textbuf.word_hashes(piece, starts, ends), return_index=True, return_inverse=True)
            word, bucket = grams(piece.data, starts[one], ends[one])
            value = np.bincount(word, model.weights[bucket], len(h)) / np.maximum(np.bincount(word, minlength=len(h)), 1)
            weight = weight_of(h, model.common, model.share)
            row = np.repeat(np.arange(len(piece)), np.diff(first))
            z = np.bincount(row, (value * weight)[place], len(piece)) / np.maximum(np.bincount(row, weight[place], len(piece)), 1e-12) + model.bias
            score = np.where(np.diff(first) > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), model.empty)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.array(score)], names=["doc_id", "score"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, and at most 10 / RARE common words
    return docs.mapInArrow(lambda b: _scored(b, shared.value), "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    scores = score(documents, train(documents, labels, max_train))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
