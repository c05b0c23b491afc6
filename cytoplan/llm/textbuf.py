"""Texts of an Arrow batch as one byte buffer, cut into words and hashed with whole-array operations.

Helpers for code inside tasks. Batches are handed on in pieces of about a megabyte, so that the arrays
beside the text stay small; one longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

PIECE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


class Piece:
    """Some neighbouring rows of a batch."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first = first  # row of the batch
        self.data = data  # UTF-8 of all texts
        self.bounds = bounds  # row i has data[bounds[i]:bounds[i + 1]]

    def __len__(self) -> int:
        return len(self.bounds) - 1


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Nulls are handed on as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("") if len(texts) else texts
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(texts), i + 20_000)
        yield Piece(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in piece.data, and for each row (and one past) its first word."""
    n = len(piece.data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SEPARATOR[piece.data], out=inside[1:-1])
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cuts = piece.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] = inside[1:-1][cuts]  # words never cross rows
    end[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, piece.bounds)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: the last step of a public 64-bit generator (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ONE, _TWO, _THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
#: Spans of up to this many bytes are two numbers; longer ones are hashed by XXH64.
SHORT = 16


def eights(data: np.ndarray) -> np.ndarray:
    """For every place in data, and one past, the next eight bytes as a number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second eight bytes of each span; with the length they are the span, if it has SHORT bytes or fewer."""
    view, size = eights(data), ends - starts
    return view[starts] & _MASK[np.minimum(size, 8)], view[np.minimum(starts + 8, len(data))] & _MASK[np.clip(size - 8, 0, 8)]


def word_hashes(piece: Piece, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words: of their two numbers and length, or XXH64 of longer ones."""
    low, high = packed(piece.data, starts, ends)
    h = joined(joined(low, high), (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts > SHORT)
    if len(long):
        raw = piece.data.tobytes()
        h[long] = [xxh64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two values in their order."""
    return mix(mix(a + _ONE) ^ (b * _TWO + _THREE))


class Runs:
    """Hashes of runs of consecutive values, equal for equal runs wherever they stand.

    Runs of 1, 2, 4 ... values are hashed from their halves, and any other run from the two of these, overlapping, that cover it.
    No hash is a sum over the run, so patterned runs do not cancel out.
    """

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = np.zeros(len(starts), np.uint64)
        for k in range(int(size.max(initial=0)).bit_length()):
            if k == len(self.levels):
                last = self.levels[-1]
                half = 1 << (k - 1)
                self.levels.append(joined(last[:-half], last[half:]))
            now = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            if len(now):
                level, n = self.levels[k], size[now].astype(np.uint64)
                out[now] = joined(level[starts[now]], level[ends[now] - (1 << k)]) ^ mix(n)
        return out
