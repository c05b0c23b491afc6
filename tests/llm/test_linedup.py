"""Line runs against brute force over all runs, not windows."""

import numpy as np
import pytest

from cytoplan.llm import common, linedup

LONG = "a line of twelve words that is long enough to count alone"


def left_by_brute_force(rows):
    """Every run of 10 words or more with an equal one at an earlier place is deleted."""
    seen, out = {}, []
    rows = [(i, t.split("\n")) for i, t in sorted(rows)]
    for i, lines in rows:
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                seen.setdefault(tuple(lines[a:b]), (i, a))
    for i, lines in rows:
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= 10 and seen[tuple(lines[a:b])] != (i, a):
                    gone |= set(range(a, b))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def test_short_last_lines_of_a_run_are_deleted(spark):
    rows = [(1, f"{LONG}\nfour words of text\nfirst"), (2, f"start\n{LONG}\nfour words of text\nsecond"), (3, f"{LONG}\nfour words of text\nfirst")]
    got = linedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, rows[0][1]), (2, "start\nsecond"), (3, "")]


@pytest.mark.parametrize("hot", [1000, 2])
def test_all_runs_match_brute_force(spark, monkeypatch, hot):
    """With hot at 2, the names of most runs are joined by a broadcast."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    r = np.random.default_rng(6)
    pool = [" ".join(f"{'abcdefgh'[k]}{j}" for j in range(n)) for k, n in enumerate((1, 1, 2, 3, 4, 6, 9, 12))]
    rows = [(i, "\n".join(pool[k] for k in r.integers(0, 8, r.integers(2, 14)))) for i in range(120)]
    rows += [(200 + i, "\n".join(["x y"] * n)) for i, n in enumerate((4, 5, 6, 17))] + [(300 + i, "\n".join(f"v{k}" for k in range(i, 25 + i))) for i in range(3)]
    got = linedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((x.doc_id, x.text, x.n_removed) for x in got.collect()) == left_by_brute_force(rows)


@pytest.mark.parametrize("hot", [1000, 2])
def test_a_doubling_writes_two_tables(spark, monkeypatch, hot):
    """First places are grouped where they are joined, and windows are named beside the runs that the next doubling needs."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    tables = []
    monkeypatch.setattr(linedup, "written", lambda df, name: tables.append(name) or common.written(df, name))
    rows = [(i, f"{LONG}\na b c d e f\n{i}\n" + "\n".join("vwxyz"[k % 5] for k in range(12))) for i in range(6)]
    got = linedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.text, x.n_removed) for x in got.collect()) == left_by_brute_force(rows)
    assert tables == ["lines", "names", *["runs", "names"] * 3, "runs"]
