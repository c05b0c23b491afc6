"""Fill-in-the-middle against slicing of strings, and back."""

import hashlib
import re

import pytest

from cytoplan.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, output int"
TEXTS = [None, "", "a", "ab", "é日🙂𝒳", "holds <S> inside", "almost <S, P>, <M", "<" * 7, "S>" * 9, "words of a text\n\nand lines \t here\n", "long " * 30_000, "\n", "e\u0301\u200d"] * 4


def plain(doc_id, text, cuts):
    text = text or ""
    at = cuts(text)
    n, h = len(at) - 1, hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x, 16) for x in re.findall("." * 8, h)[:4])
    a, b = sorted((at[h1 % (n + 1)], at[h2 % (n + 1)]))
    x, y, z = text[:a], text[a:b], text[b:]
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    form, out = ("spm", f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 20 else ("psm", f"<P>{x}<S>{z}<M>{y}")
    return doc_id, n, form, len(x), len(y), out


CUTS = {
    "code points": lambda t: list(range(len(t) + 1)),
    "words": lambda t: [0] + [m.end() for m in re.finditer(r"[\t-\r ]+|[^\t-\r ]+", t)],
    "lines": lambda t: [0] + [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+$", t)],
}


@pytest.mark.parametrize("unit", fim.UNITS)
def test_against_slices_and_back(spark, unit):
    rows = [*enumerate(TEXTS), (None, "null id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(i, t, 1, "f", 2) for i, t in rows], SCHEMA).repartition(3)
    got = fim.transform(docs, fim.Plan(unit=unit))
    want = [plain(i, t, CUTS[unit]) for i, t in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((tuple(r) for r in fim.digests(got).collect()), key=str) == sorted(((*w[:5], sha(w[5]), sha(t)) for w, (_, t) in zip(want, rows, strict=True)), key=str)
    assert fim.transform(docs.where("false")).count() == 0


def test_unknown_unit_is_refused(spark):
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([], SCHEMA), fim.Plan(unit="bytes"))
