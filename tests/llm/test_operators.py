"""The training-data operators against brute force, on a small fixture with all the awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from cytoplan.llm import bpe, decontaminate, htmltext, importance, linedup, ngrams, quality_rules, simhash, substrings, textbuf, tokenfile, toxicity

SCHEMA = "doc_id long, text string, row int, words string, copy int, lang string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def prose(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    return " ".join(f"{'abcdefghij'[k % 10]}w{k}" + ("\n" if r.random() < 0.08 else "") for k in r.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 300)
    near = base.split(" ")
    near[150] = "changed"
    out = [base, base, " ".join(near), prose(2, 120) + " " + base[400:1200], prose(3, 80), None, "", " \n\t ", "one", "The 's don't  　x 123½ <|endoftext|> é日本 🙂", "a b " * 200]
    out += [prose(4, 5000), "line of ten words that is long enough to count\n" * 4, "x\nline of ten words that is long enough to count\ny", prose(5, 90) + "\n" + prose(6, 40)]
    return [(i, t) for i, t in enumerate(out)] + [(4, out[4]), (4, prose(7, 60))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "w", 9, "en") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(texts):
    return sorted(texts, key=lambda x: (x[0], x[1] or ""))


def test_windows_match_brute_force(docs, texts, none):
    seen, want = set(), []
    for i, t in ordered(texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = [tuple(r) for r in substrings.digests(substrings.dedup(docs)).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.dedup(none).count() == 0


def test_automaton_finds_every_repeated_stretch():
    r = np.random.default_rng(0)
    for _ in range(200):
        known = [r.integers(0, 3, r.integers(1, 12)).tolist() for _ in range(4)]
        probe, a = r.integers(0, 3, 15).tolist(), substrings.Automaton()
        for k in known:
            a.add(k)
        spans = {tuple(k[x:y]) for k in known for x in range(len(k)) for y in range(x + 1, len(k) + 1)}
        want = [max([0, *(n for n in range(1, e + 1) if tuple(probe[e - n : e]) in spans)]) for e in range(1, 16)]
        assert a.matching(probe) == want


def test_line_runs_match_brute_force(docs, texts, none):
    seen, want = set(), []
    for i, t in ordered(texts):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        for k in range(len(at)):
            m, n = k, 0
            while m < len(at) and n < linedup.MIN_WORDS:
                n, m = n + len(words(lines[at[m]])), m + 1
            if n < linedup.MIN_WORDS:
                continue
            key = tuple(lines[x] for x in at[k:m])
            if key in seen:
                gone |= set(at[k:m])
            seen.add(key)
        want.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    got = [(r.doc_id, r.text, r.n_removed) for r in linedup.dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in got) > 3 and linedup.dedup(none).count() == 0


def test_simhash_matches_brute_force(docs, texts, none):
    def fingerprint(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fingerprint(t)) for i, t in texts]
    group = list(range(len(prints)))
    for _ in prints:
        group = [min(group[b] for b, (_, y) in enumerate(prints) if (x ^ y).bit_count() <= 4) for _, x in prints]
    least = {g: min(prints[k][0] for k in range(len(prints)) if group[k] == g) for g in group}
    want = sorted((i, format(x, "016x"), least[g]) for (i, x), g in zip(prints, group, strict=True))
    from pyspark.sql import functions as F

    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex(F.col("fp")), "component_id")
    assert sorted(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(none).count() == 0


def test_tree_links_connect_what_brute_force_connects():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    points = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 6).astype(np.uint64)) for _ in range(40)]))
    a, b = simhash._tree_links(points, 4)
    assert all((x ^ y).bit_count() <= 4 for x, y in zip(a, b, strict=True))
    name = {int(p): int(p) for p in points}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for x, y in zip(a, b, strict=True):
        name[find(x)] = find(y)
    for p in points.tolist():
        for q in points.tolist():
            if (p ^ q).bit_count() <= 4:
                assert find(p) == find(q)


def test_bpe_equals_the_library(docs, texts, none):
    t = Tokenizer.from_file(bpe.default_tokenizer())
    want = []
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(bpe.decode(bpe.encode(docs))).collect())) == sorted(want)
    assert bpe.encode(none).count() == 0


def test_bpe_of_odd_strings():
    t = Tokenizer.from_file(bpe.default_tokenizer())
    parts = ["'s", "'ll", " ", "  ", "\n", "a", "é", "日本", "1", "½", "''", "!!", "<|endoftext|>", "<|endof", " ", "\x1c", "\x85", "the", "ing", "🙂", "'re", "don't", "　", "aaaa", "'r"]
    r = np.random.default_rng(8)
    odd = ["".join(r.choice(parts, r.integers(1, 25))) for _ in range(3000)] + ["", "a" * 3000, " " * 500]
    want = [e.ids for e in t.encode_batch(odd, add_special_tokens=False)]
    assert bpe.encoder(bpe.default_tokenizer()).encode_texts(odd) == want
    assert tokenfile._library_encoder(bpe.default_tokenizer()).encode_texts(odd) == want
    v = bpe.vocabulary(bpe.default_tokenizer())
    for ids in r.integers(0, 50257, (500, 5)):
        assert bpe.decode_text(v, ids) == t.decode(ids.tolist(), skip_special_tokens=False)


def test_token_file_round_trip(docs, texts, none):
    t = Tokenizer.from_file(bpe.default_tokenizer())
    at, want = 0, []
    for i, x in ordered(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tokenfile.round_trip(docs).collect()]
    assert sorted(got) == sorted(want)
    assert tokenfile.round_trip(none).count() == 0


def test_blocks_decode_in_stretches_and_detect_damage():
    ids = np.random.default_rng(2).zipf(1.3, 5000) % 50000
    table = tokenfile.Table.fit(ids)
    block = tokenfile.encode_block(ids, table, lanes=16, steps=32)
    again = tokenfile.Table.unpack(table.pack())
    assert (tokenfile.decode_block(block, again, again.slots()) == ids).all()
    assert (tokenfile.decode_block(block, table, table.slots(), range(2, 4)) == ids[1024:2048]).all()
    with pytest.raises(ValueError):
        tokenfile.decode_block(block[:-1] + bytes([block[-1] ^ 1]), table, table.slots())
    one = np.full(7, 5)
    assert (tokenfile.decode_block(tokenfile.encode_block(one, tokenfile.Table.fit(one)), tokenfile.Table.fit(one), tokenfile.Table.fit(one).slots()) == one).all()


def test_decontamination_matches_brute_force(spark, none):
    item = prose(20, 30)
    worse = item.split()
    worse[3], worse[11], worse[25] = "X", "Y", "Z"
    del worse[17]
    far = [w if k % 3 else "q" for k, w in enumerate(item.split())]
    texts = [item, f"{prose(21, 50)} {item.upper()} {prose(22, 50)}", " ".join(worse), " ".join(far), None, "", prose(23, 400), " ".join(worse[:12])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame([(0, item), (1, prose(24, 25)), (2, None), (3, "tiny item")], "item_id long, text string")

    def distance(p, t):
        row = list(range(len(p) + 1))
        best = row[-1]
        for w in t:
            new = [0]
            for k in range(1, len(p) + 1):
                new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (p[k - 1] != w)))
            row, best = new, min(best, new[-1])
        return best

    want = set()
    for i, t in enumerate(texts):
        for k, x in b.collect():
            p = words((x or "").lower())
            if p and (n := distance(p, words((t or "").lower()))) <= decontaminate.errors(len(p)):
                want.add((i, k, n))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contamination(d, b).collect()}
    assert got == want and {(0, 0, 0), (1, 0, 0), (2, 0, 4)} <= got
    assert decontaminate.contamination(d, b.limit(0)).count() == 0 and decontaminate.contamination(none, b).count() == 0


def test_benchmark_blocks_copies_and_awkward_rows(spark, monkeypatch):
    item, other, long = prose(61, 25), prose(62, 25), prose(63, 3000, 5000)
    texts = [(1, f"x {item} y"), (1, prose(64, 30)), (None, f"{other}"), (None, "clean"), (2, None), (3, f"{prose(65, 2000)} {long} {prose(66, 20_000)}"), (4, f"x {item} y")]
    docs = spark.createDataFrame([(i, t, 1, "w", 3) for i, t in texts], "doc_id long, text string, item_id long, distance string, end_word int")
    items = spark.createDataFrame([(7, item), (8, item), (8, prose(67, 25)), (9, other), (10, long), (11, None), (None, other)], "item_id long, text string")
    want = {(1, 7, 0), (1, 8, 0), (None, 9, 0), (None, None, 0), (3, 10, 0), (4, 7, 0), (4, 8, 0)}
    seen = []
    for most, size in ((20_000, 1 << 24), (2, 1 << 24), (20_000, 300)):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", most)
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=str)
        assert {r[:3] for r in got} == want and len(got) == len(want)
        seen.append(got)
        kept = decontaminate.without_contaminated(docs, items)
        assert kept.columns == docs.columns and sorted((str(r.doc_id), str(r.text)[:5]) for r in kept.collect()) == sorted([("1", texts[1][1][:5]), ("None", "clean"), ("2", "None")])
    assert seen[0] == seen[1] == seen[2]
    assert decontaminate.without_contaminated(docs, items.where("false")).count() == 7


def test_html_blocks():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies to make this site work for all of you.</div><article><h1>A &amp; B</h1><p>The first   paragraph of the
    text, with a <a href=x>link</a> in it, is long enough to be decided on its own.</p><p>Short.</p><script>var x="</p>";</script>
    <aside>See also</aside><section id="comments"><p>This comment is by a reader and not of the article at all.</p></section></article><footer>&copy; me"""
    assert htmltext.main_text(page) == "A & B\nThe first paragraph of the text, with a link in it, is long enough to be decided on its own.\nShort."
    plain = "<body><ul><li><a href=/>One</a></li><li><a href=/>Two</a></li></ul><p>" + "It is the text of the page and it was here for all of you to read. " * 4 + "</p><p>So short</p><p>" + "And this is more of the text that we have for you in the end. " * 4 + "</p>"
    assert htmltext.main_text(plain).count("\n") == 2 and "One" not in htmltext.main_text(plain)
    assert htmltext.main_text(None) == htmltext.main_text("") == ""
    assert htmltext.main_text("<article><p>a<b>c &lt;x&gt;") == "ac <x>"


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, None, "<article><p>Hi</p></article>", 5), (2, None, "", 5)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, htmltext.extract(pages).collect()), key=str) == [(1, "u", "", 0), (2, None, "", 0), (2, None, "Hi", 2)]


def test_toxicity_learns_misspellings(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(600):
        w = prose(1000 + i, 40, 300).split()
        if toxic := int(i % 4 == 0):
            w[r.integers(0, len(w))] = str(r.choice(["horrible", "horribly", "horribles"]))
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame(rows + [(9000, None, 0), (9001, "", 0), (9002, " ".join(prose(5, 20).split() + ["horriblest"] * 3), 1)], "doc_id long, text string, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs.select("doc_id", "text"), docs.where("doc_id < 9000").select("doc_id", "toxic")).collect()}
    held = [(got[i].score, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    auc = np.mean([a > b for a, y in held if y for b, z in held if not z])
    assert auc > 0.9 and len(got) == 603
    learned = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    assert got[9000].score == got[9001].score == pytest.approx(np.mean(learned)) and got[9000].predicted == 0
    assert got[9002].score > np.median([x.score for x in got.values()])
    assert all(x.predicted == int(x.score >= 0.5) for x in got.values())


def plain_scores(model, texts):
    """The averages word by word: n-grams of the marked word and the word itself, then the words' weighted mean."""
    out = []
    for t in texts:
        total = weight = 0.0
        for w in words((t or "").encode().lower().decode()):
            raw = f"<{w}>".encode()
            piece = textbuf.Piece(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            keys = [int(textbuf.word_hashes(piece, np.array([0]), np.array([len(raw)]))[0])]
            keys += [int(textbuf.mix(np.array([int.from_bytes(raw[k : k + n], "little") | n << 56], np.uint64))[0]) for n in (3, 4, 5) for k in range(len(raw) - n + 1)]
            own = textbuf.Piece(0, np.frombuffer(raw[1:-1], np.uint8), np.array([0, len(raw) - 2]))
            h = textbuf.word_hashes(own, np.array([0]), np.array([len(raw) - 2]))[0]
            share = dict(zip(model.common.tolist(), model.share.tolist(), strict=True)).get(int(h), 0.0)
            part = toxicity.RARE / (toxicity.RARE + share)
            total += part * np.mean([model.weights[k % toxicity.BUCKETS] for k in keys])
            weight += part
        out.append(1 / (1 + np.exp(-(total / weight + model.bias))) if weight else model.empty)
    return out


def test_toxicity_scores_are_the_plain_averages(spark):
    texts = [f"{prose(k, 30, 60)} {'vile' if k % 3 == 0 else 'kind'} It's é日 A" for k in range(60)]
    model = toxicity.fit(texts, np.array([float(k % 3 == 0) for k in range(60)], np.float32))
    more = [*texts[:6], None, "", " \n", "unseenword", "x", "vilest " * 3000, prose(9, 4000)]
    docs = spark.createDataFrame([(None if k == 2 else k, t, 1.0, 2) for k, t in enumerate(more)], "doc_id long, text string, score double, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = plain_scores(model, more)
    assert np.allclose([got[None if k == 2 else k] for k in range(len(more))], want, atol=1e-5)


def test_toxicity_of_null_ids_and_empty_tables(spark):
    rows = [(None, "one text"), (None, None), (1, "vile text"), (2, "kind text"), (3, "kind words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 5 and all(not r.held_out and 0 <= r.score <= 1 for r in got if r.doc_id is None)
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0 and toxicity.toxicity(docs, labels.where("false")).count() == 5


def test_toxicity_without_labels(docs, spark, texts):
    got = toxicity.toxicity(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(texts) and {x.score for x in got} == {0.5}


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    in_repeat = {k + j for k, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(in_repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(in_repeat), failed


def test_quality_base_counts(docs, texts, spark, none):
    labels = spark.createDataFrame([(0, 1), (3, 1), (4, 0), (4, None)], "doc_id long, quality int")
    small = docs.where("doc_id != 11")
    got = quality_rules.quality_rules(small, labels).collect()
    mine = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert mine == sorted((i, *base(t)) for i, t in texts if i != 11)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_resampling_takes_the_highest_keys(spark, none):
    rows = [(i, prose(i, 60, 50) if i % 3 else " ".join(f"junk{k}" for k in range(60))) for i in range(90)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int")
    ratios = quality_rules.fit(docs, labels)
    scored = sorted(importance.scores(docs, ratios).collect(), key=lambda r: -r.key)
    got = importance.resample(docs, labels, share=0.5).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in scored[:46]}
    assert sum(r.doc_id % 3 == 0 for r in got) < 5
    assert importance.resample(none, labels).count() == 0
    same = spark.createDataFrame([(None, prose(i, 60, 50)) for i in range(40)] + [(None, None)], "doc_id long, text string")
    noise = {round(r.key / ngrams.SCALE - r.log_weight, 4) for r in importance.scores(same, ratios).collect()}
    assert len(noise) == 41
    for k in (1, 7, 92):
        assert importance.kth_highest(importance.scores(docs, ratios), k, bits=3) == scored[k - 1].key
