"""Spelling variants against pairwise comparison of all words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cytoplan.llm import spelling

SCHEMA = "doc_id long, text string, n long, word string, key int"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows, ratio=10):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    total = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in total if one_apart(v, w)] for w in total}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-total[v], v), default=None)
        form[w] = best if best and total[best] >= ratio * total[w] else None
    out = []
    for w in total:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, total[w], len(near[w]), total.get(form[w])))
    return sorted(out, key=str)


def typo(r, word):
    k, c = int(r.integers(0, len(word))), "aeéßz÷"[int(r.integers(0, 6))]
    return [word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]][int(r.integers(0, 3))]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    base = ["aabbccdd", "letters", "LETTERS", "spelling", "SpÉlling", "mississippi", "zzzzzzzz", "x" * 64, "x" * 65, "ab" * 40, "q" * 3000, "été" * 30]
    out = [(None, "letters letters"), (None, None), (0, ""), (1, "no-word \u0131\u212a123 short"), (2, "a" * 20_000 + " " + "a" * 19_999 + " b" + "a" * 19_999), (3, "a" * 20_000 + " " + "a" * 19_999 + " b" + "a" * 19_999)]
    for i in range(120):
        words = [base[k] for k in r.choice(len(base), 60, p=np.array([30, 20, 10, 8, 4, 4, 2, 2, 2, 1, 1, 1]) / 85)]
        words = [typo(r, w) if r.random() < 0.1 else w for w in words]
        words += [typo(r, typo(r, w)) for w in words[:2]] + ["rootword"] * 5 + ["rootwood"] * (i % 3 == 0) + ["rootwooed"] * (i in (3, 30))  # a chain of forms
        out.append((i, " ".join(words)))
    return out + [out[10], out[10], (10, "letters")]


def test_against_all_pairs(spark, rows):
    want = brute(rows)
    assert max(w[4] for w in want) > 20 and sum(w[1] is not None for w in want) > 20 and any(w[1] and len(w[0]) > 64 for w in want)
    assert any(w[1] and w[2] != w[1] for w in want)
    docs = spark.createDataFrame([(i, t, 1, "w", 2) for i, t in rows], SCHEMA).repartition(3)
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_and_ties(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(["wordsaa"] * 40 + ["wordsab"] * 40 + ["wordsac"] * 2 + ["alonealone"] * 2)
    rows = [(k, text) for k in range(3)]
    got = spelling.variants(spark.createDataFrame([(i, t, 0, None, None) for i, t in rows], SCHEMA))
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(rows)


def test_keys_grow_with_the_word():
    keys = list(spelling.keys_of("ab" * 20_000))
    assert len(keys) == 3 * 40_000 + 1 and max(len(k) for k, _ in keys) < 80
    assert [k for k, kind in spelling.keys_of("aabbb") if kind == spelling.DELETION] == ["abbb", "aabb"]
