"""Words of equal polynomial hashes, hot anchors and large shards, and the queries that SQL can express."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cytoplan.llm import bpe, importance, ngrams, quality_rules, queries, simhash, substrings, textbuf, tokenfile

DATA = "/root/testdata/sf0.001"


def twins(n):
    """Two different words whose hashes by any polynomial modulo 2 ** 64 are equal: the Thue-Morse word and its complement."""
    bits = [k.bit_count() % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module")
def patterned(spark):
    texts = [x for n in (1024, 2048) for x in twins(n)]
    texts += [f"{a}\n{b}" for a, b in (twins(1024), twins(2048))]
    texts += [" ".join([w] * 30) for w in twins(1024)] + [" ".join(w) for w in twins(2048)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bpe_of_patterned_words(patterned):
    texts, docs = patterned
    t = Tokenizer.from_file(bpe.default_tokenizer())
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    want = [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids]
    got = bpe.digests(bpe.decode(bpe.encode(docs))).orderBy("doc_id").collect()
    assert [r.ids_sha256 for r in got] == want
    assert [r.decoded_sha256 for r in got] == [hashlib.sha256(x.encode()).hexdigest() for x in texts]
    files = {r.doc_id: zlib.crc32(r.ids) for r in tokenfile.round_trip(docs).collect()}
    assert files == {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(ids)}


def removed_by_brute_force(texts, window=20):
    seen, out = set(), []
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone)))
    return out


def test_windows_of_patterned_words(patterned):
    texts, docs = patterned
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(docs).orderBy("doc_id").collect()]
    assert got == removed_by_brute_force(texts)


@pytest.mark.parametrize("hot", [0, 3, 10_000])
def test_windows_of_a_frequent_anchor(spark, hot):
    r = np.random.default_rng(9)
    phrase = " ".join(f"common{k}" for k in range(12))
    texts = []
    for k in range(60):
        before, after = (" ".join(f"v{x}" for x in r.integers(0, 3, 9)) for _ in range(2))
        texts.append(f"{before} {phrase} {after}" + (f" {texts[k // 2]}" if k % 7 == 3 else ""))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(docs, hot=hot).orderBy("doc_id").collect()]
    assert got == removed_by_brute_force(texts) and sum(x[2] for x in got) > 200


def test_busy_anchors_are_dealt_by_content(spark, monkeypatch):
    r = np.random.default_rng(10)
    phrase = " ".join(f"common{k}" for k in range(12))
    texts = [" ".join(f"v{x}" for x in r.integers(0, 3, 9)) + f" {phrase} " + " ".join(f"v{x}" for x in r.integers(0, 3, 9)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substrings, "BUSY", 20)
    monkeypatch.setattr(substrings, "BUSY_LOCAL", 1)
    assert len(substrings.busy_anchors(docs.selectExpr("doc_id AS id", "0 AS copy", "text"), 20, 8)) > 0
    got = [(x.doc_id, x.n_words, x.n_removed) for x in substrings.dedup(docs, hot=30).orderBy("doc_id").collect()]
    assert got == removed_by_brute_force(texts)


def test_runs_are_equal_exactly_when_their_values_are():
    values = np.random.default_rng(0).integers(0, 2, 300).astype(np.uint64)
    runs, seen = textbuf.Runs(values), {}
    starts, ends = np.array([(a, b) for a in range(300) for b in range(a + 1, min(300, a + 20) + 1)]).T
    for a, b, h in zip(starts, ends, runs.of(starts, ends).tolist(), strict=True):
        assert seen.setdefault(h, tuple(values[a:b])) == tuple(values[a:b])
    assert len(seen) == len(set(seen.values()))


def test_large_shards_are_split_without_losing_a_link(spark):
    r = np.random.default_rng(12)
    base = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    points = base[r.integers(0, 4, 3000)]
    for _ in range(4):
        points = points ^ (np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64))
    points = np.unique(points)
    frame = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").select(F.lit(1).cast("long").alias("shard"), "fp")
    shards = simhash.split_large(frame, 4, most=300).groupBy("shard").agg(F.collect_list("fp").alias("fp")).collect()
    assert len(shards) > 4
    together = set()
    for s in shards:
        own = np.array(s.fp, np.int64).view(np.uint64)
        a, b = np.nonzero(np.bitwise_count(own[:, None] ^ own[None]) <= 4)
        together |= {(x, y) for x, y in zip(own[a].tolist(), own[b].tolist(), strict=True) if x < y}
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 4)
    assert together == {(x, y) for x, y in zip(points[a].tolist(), points[b].tolist(), strict=True) if x < y}


def test_fingerprints_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (3, "a b c d e f g"), (None, "other words are these ones here"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3), (4, 4), (None, 3), (None, None)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.SQL[name]).fetchall()
    got = [tuple(r) for r in queries.queries()[name](spark, DATA).collect()]
    assert sorted(got) == sorted(want) and len(got) == 200


def bins_by_brute_force(text):
    from xxhash import xxh64_intdigest

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    w = (text or "").split()
    one = [xxh64_intdigest(x.encode(), 42) for x in w]
    two = [xxh64_intdigest(b.encode(), a) for a, b in zip(one, w[1:], strict=False)]
    return [signed(h) % ngrams.BUCKETS for h in one + two]


def test_verdicts_and_weights_match_brute_force(spark):
    r = np.random.default_rng(14)
    text = lambda kind: " ".join(f"{kind}{k}" for k in r.integers(0, 60, r.integers(1, 160)))
    rows = [(i, text("good" if i % 3 else "junk")) for i in range(150)] + [(150, None), (151, ""), (152, "one two"), (152, "one two"), (None, text("good"))]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, bins int, words string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (61, None)], "doc_id long, quality int")
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(bins_by_brute_force(t))
        target.update(bins_by_brute_force(t) if i is not None and i < 60 and i % 3 else [])
    share = target.total() / raw.total()
    ratio = {b: round(ngrams.SCALE * float(np.log((target[b] + ngrams.PRIOR * share) / ((raw[b] + ngrams.PRIOR) * share)))) for b in raw}
    total = [sum(ratio[b] for b in bins_by_brute_force(t)) for _, t in rows]
    got = quality_rules.quality_rules(docs, labels).collect()
    limit = round(quality_rules.THRESHOLD * ngrams.SCALE)
    want = []
    for (i, t), s in zip(rows, total, strict=True):
        w = (t or "").split()
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k + j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 2 * len(repeated) > len(w)
        want.append((i, failed, not failed and s >= max(1, 2 * len(w) - 1) * limit))
    assert sorted(map(str, want)) == sorted(str((x.doc_id, x.base_failed, x.kept)) for x in got)
    assert 20 < sum(x.kept for x in got) < 100
    weights = importance.scores(docs, quality_rules.fit(docs, labels)).collect()
    mine = [(i, (s - (0 if (t or "").split() else importance.EMPTY_PENALTY)) / ngrams.SCALE) for (i, t), s in zip(rows, total, strict=True)]
    assert sorted(map(str, mine)) == sorted(str((x.doc_id, x.log_weight)) for x in weights)
