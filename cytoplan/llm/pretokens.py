"""Byte-level BPE files: reading one, and encoding texts by their distinct pretokens.

A worker keeps the ids of the pretokens that it has met, up to ``MOST_WORDS``, so that a pretoken is
encoded once however often it stands in the texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from cytoplan.llm import textbuf

#: The published split pattern of byte-level BPE; white space is the Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A worker's store of pretokens starts anew beyond this; its memory is bounded, results do not change.
MOST_WORDS, MOST_BYTES = 1_000_000, 1 << 25


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, special tokens, and merges as arrays by token id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.ids = {bytes(of[c] for c in name): i for name, i in names.items()}
        size = max(*names.values(), *self.special.values()) + 1
        self.tokens = [b""] * size
        for token, i in [*self.ids.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.tokens[i] = token
        self.longest = max(map(len, self.ids))
        # rank: 0 for a byte, else the place of the merge that makes the token, from 1 on.
        self.rank, self.left, self.right = (np.zeros(size, np.int64) for _ in range(3))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"], 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = names[a], names[b], names[a + b]
            self.merges[a, b] = (k, made)
            self.rank[made], self.left[made], self.right[made] = k, a, b
        pairs = sorted((a << 32 | b, k) for (a, b), (k, _) in self.merges.items())
        self.pair_keys = np.array([p for p, _ in pairs], np.int64)
        self.pair_ranks = np.array([k for _, k in pairs], np.int64)
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_starts = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens])))

    def text_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that these ids stand for, joined."""
        return gathered(self.token_bytes, self.token_starts, ids)


def gathered(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i + 1]] for each i of which, joined."""
    size = starts[which + 1] - starts[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts[which] - (ends - size), size)]


LETTER, NUMBER, SPACE, OTHER = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))  # without surrogates
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            low, high = (k if k < 0xD800 else k + 0x800 for k in m.span())
            out[low:high] = kind
    return out


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    table = classes()
    kind = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b0 = data[lead].astype(np.int32)
        more = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F
        two = (b0 & 0x1F) << 6 | more(1)
        three = (b0 & 0x0F) << 12 | more(1) << 6 | more(2)
        four = (b0 & 0x07) << 18 | more(1) << 12 | more(2) << 6 | more(3)
        point = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
        kind[lead] = own = table[point]
        kind[lead + 1] = own
        for k, least in ((2, 0xE0), (3, 0xF0)):
            long = b0 >= least
            kind[lead[long] + k] = own[long]
    return kind


def _starts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where the matches of PATTERN begin, as the pattern is applied to each stretch between cuts by itself."""
    n = len(data)
    kind = _byte_classes(data)
    cut = np.zeros(n + 1, bool)
    cut[cuts] = True
    run = np.ones(n + 1, bool)
    run[1:n] = kind[1:] != kind[:-1]
    run |= cut
    start = run.copy()
    space = kind == SPACE
    # The last character of white space before something else stands alone, or with it if it is a blank.
    ends = np.flatnonzero(run[1:] & space) + 1  # one past a run of white space
    ends = ends[~cut[ends]]
    last = ends - 1
    while (inner := (data[last] & 0xC0) == 0x80).any():
        last[inner] -= 1
    start[last] = True
    start[ends[data[ends - 1] == 0x20]] = False
    # An apostrophe and the letters of a contraction.
    quote = np.flatnonzero((data == 0x27) & start[:n])
    quote = quote[quote + 1 < n]
    if len(quote):
        quote = quote[(kind[quote + 1] == LETTER) & ~cut[quote + 1]]
        one = data[quote + 1]
        two = np.where((quote + 2 < n) & ~cut[np.minimum(quote + 2, n)], data[np.minimum(quote + 2, n - 1)], 0)
        size = np.where(np.isin(one, list(b"stmd")), 1, 0)
        for pair in (b"re", b"ve", b"ll"):
            size[(one == pair[0]) & (two == pair[1])] = 2
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + 1 + size] = True
    return np.flatnonzero(start[:n])


class _Store:
    """Short pretokens (their two numbers and length) with the place of each, found by hash and compared exactly."""

    def __init__(self):
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.own = np.zeros((3, 0), np.uint64)

    def find(self, h: np.ndarray, own: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where((self.hash[at] == h) & (self.own[:, at] == own).all(0), self.place[at], -1)

    def add(self, h: np.ndarray, own: np.ndarray, place: np.ndarray) -> None:
        h, own, place = np.concatenate((self.hash, h)), np.concatenate((self.own, own), 1), np.concatenate((self.place, place))
        order = np.argsort(h, kind="stable")
        self.hash, self.own, self.place = h[order], own[:, order], place[order]


class Encoder:
    """Encodes texts; encode_words gives the ids of distinct pretokens, joined, and the count of each."""

    def __init__(self, special: dict[str, int], encode_words: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.special = {k.encode(): v for k, v in special.items()}
        self.encode_words = encode_words
        self.clear()

    def clear(self) -> None:
        self.old, self.recent = _Store(), _Store()
        self.longer: dict[bytes, int] = {}
        self.longer_bytes = 0
        self.ids, self.starts = [np.zeros(0, np.uint32)], np.zeros(1, np.int64)

    def _specials(self, data: bytes) -> list[tuple[int, int, int]]:
        """Start, end and id of every special token, the leftmost first."""
        found: list[tuple[int, int, int]] = []
        for m in regex.finditer(b"|".join(map(regex.escape, self.special)), data) if any(s in data for s in self.special) else ():
            found.append((m.start(), m.end(), self.special[m[0]]))
        return found

    def _places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of every pretoken among those that the store holds; new ones are encoded."""
        raw, word = data.tobytes(), np.empty(len(start), np.int64)
        own = np.stack((*textbuf.packed(data, start, end), (end - start).astype(np.uint64)))
        h = textbuf.joined(textbuf.joined(own[0], own[1]), own[2])
        short = end - start <= textbuf.SHORT
        at = np.flatnonzero(short)
        distinct, one, of = np.unique(h[at], return_index=True, return_inverse=True)
        first = own[:, at[one]]
        unlike = (first[:, of] != own[:, at]).any(0)  # equal hashes of unequal bytes
        short[at[unlike]] = False
        place = self.old.find(distinct, first)
        place = np.where(place < 0, self.recent.find(distinct, first), place)
        new = np.flatnonzero(place < 0)
        fresh = [raw[x:y] for x, y in zip(start[at[one[new]]].tolist(), end[at[one[new]]].tolist(), strict=True)]
        place[new] = known = len(self.starts) - 1 + np.arange(len(new))
        word[at] = place[of]
        for i in np.flatnonzero(~short).tolist():
            token = raw[start[i] : end[i]]
            if (got := self.longer.get(token)) is None:
                got = self.longer[token] = len(self.starts) - 1 + len(fresh)
                self.longer_bytes += len(token)
                fresh.append(token)
            word[i] = got
        if fresh:
            ids, counts = self.encode_words(fresh)
            self.ids = [np.concatenate((*self.ids, ids.astype(np.uint32)))]
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts)))
            self.recent.add(distinct[new], first[:, new], known)
            if 8 * len(self.recent.hash) > len(self.old.hash):
                self.old.add(self.recent.hash, self.recent.own, self.recent.place)
                self.recent = _Store()
        return word

    def encode(self, piece: textbuf.Piece) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined (uint32), and where each text's ids start, with the end."""
        data, n = piece.data, len(piece.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(piece) + 1, np.int64)
        if len(self.starts) > MOST_WORDS or self.longer_bytes > MOST_BYTES:
            self.clear()
        special = self._specials(data.tobytes()) if self.special else []
        cuts = np.unique(np.concatenate((piece.bounds, np.array([x for s in special for x in s[:2]], np.int64))))
        start = _starts(data, cuts)
        if special:
            inside = np.zeros(n + 1, np.int64)
            for low, high, _ in special:
                inside[low + 1] += 1
                inside[high] -= 1
            start = start[np.cumsum(inside)[start] == 0]
        end = np.append(start[1:], n)
        word = self._places(data, start, end)
        size = self.starts[word + 1] - self.starts[word]
        where = np.searchsorted(start, np.array([s[0] for s in special], np.int64))
        size[where] = 1
        ends = np.concatenate(([0], np.cumsum(size)))
        begin = self.starts[word]
        out = self.ids[0][np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        out[ends[where]] = [s[2] for s in special]
        return out, ends[np.searchsorted(start, piece.bounds)]

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        found = []
        for piece in textbuf.pieces(pa.array(texts, pa.string())):
            ids, at = self.encode(piece)
            found += [ids[x:y].tolist() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return found
