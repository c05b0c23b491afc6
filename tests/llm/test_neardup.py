"""The near-dedup stage against brute-force Jaccard."""

import corpus_pipeline as pipeline
import numpy as np

from cytoplan.llm import neardup

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def first_of_groups(sets):
    group = list(range(len(sets)))
    near = [[j for j, b in enumerate(sets) if a == b or jaccard(a, b) >= 0.8] for a in sets]
    while (new := [min(group[j] for j in n) for n in near]) != group:
        group = new
    return sorted(set(group))


def near_copies():
    """Pairs of Jaccard 0.6 to 0.97: some words of one copy are changed."""
    r = np.random.default_rng(3)
    texts = []
    for k in range(60):
        base = [f"w{x}" for x in r.integers(0, 5000, 260)]
        copy = list(base)
        for x in r.choice(260, 1 + k % 12, replace=False):
            copy[x] = f"new{x}"
        texts += [" ".join(base), " ".join(copy).upper()]
    return texts


def test_stage_keeps_one_of_every_group_at_jaccard_08(spark):
    texts = near_copies() + [None, "", " \n", "one two", "one  TWO", "one two three"]
    sets = [shingles(t) for t in texts]
    found = [jaccard(sets[k], sets[k + 1]) for k in range(0, 120, 2)]
    assert sum(0.8 <= j < 0.95 for j in found) > 15 and sum(j < 0.8 for j in found) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert got == first_of_groups(sets)


def test_large_groups_are_compared_in_blocks(spark):
    """One family of drifting copies, many blocks long, whose neighbours are near and whose ends are not."""
    r = np.random.default_rng(7)
    words, texts = [f"w{k}" for k in range(120)], []
    for k in range(90):
        words[int(r.integers(0, 120))] = f"new{k}"
        texts += [" ".join(words)] if k % 9 else []
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, copy int, text string").repartition(3)
    want = first_of_groups([shingles(t) for t in texts])
    for block in (3, 10, 1000):
        got = neardup.first_copies(docs, pipeline.SHINGLE, block).collect()
        assert sorted(x.doc_id for x in got) == want


def test_exact_links_connect_what_brute_force_connects():
    r = np.random.default_rng(4)
    for _ in range(30):
        base = r.choice(10_000, 40, replace=False)
        sets = [np.unique(np.concatenate((r.choice(base, r.integers(30, 41), replace=False), r.integers(10_000, 99_999, r.integers(0, 3))))) for _ in range(40)]
        a, b = neardup.exact_links(np.concatenate(sets).astype(np.uint64), np.array([len(s) for s in sets]))
        own = [set(s.tolist()) for s in sets]
        assert all(jaccard(own[x], own[y]) >= 0.8 for x, y in zip(a, b, strict=True))
        name = list(range(40))
        for x, y in zip(a, b, strict=True):
            name = [name[x] if n == name[y] else n for n in name]
        assert all(name[x] == name[y] for x in range(40) for y in range(40) if jaccard(own[x], own[y]) >= 0.8)
        assert len(a) == 40 - len(set(name))


def test_near_copies_among_rows_of_one_doc_id(spark):
    words = [f"w{k}" for k in range(200)]
    near, far = " ".join([*words[:-1], "other"]), " ".join(f"q{k}" for k in range(200))
    rows = [(1, " ".join(words)), (2, near), (2, far), (3, f"{far} end")]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
