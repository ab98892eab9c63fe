"""Nearest times, runs and the hash table against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.llm.hashing import HashTable
from callweave.llm.nearest import XFastTrie, nearest_in_time
from callweave.llm.runs import collapse_runs


@given(st.lists(st.integers(0, 2**63 - 1), unique=True, max_size=200), st.lists(st.integers(0, 2**63 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_hash_table(keys, asked):
    table = HashTable(np.array(keys, np.uint64), np.arange(len(keys)))
    where = {k: i for i, k in enumerate(keys)}
    assert table.get(np.array(keys, np.uint64)).tolist() == list(range(len(keys)))
    assert table.get(np.array(asked, np.uint64)).tolist() == [where.get(k, -1) for k in asked]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 255)), unique=True, max_size=60), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 255)), max_size=40))
@settings(max_examples=80, deadline=None)
def test_trie_neighbours(stored, asked):
    stored = sorted(stored)
    e, t = (np.array([x[i] for x in stored], np.int64) for i in (0, 1))
    pred, succ = XFastTrie(e, t, 8).neighbours(*(np.array([x[i] for x in asked], np.int64) for i in (0, 1)))
    for (qe, qt), p, s in zip(asked, pred, succ):
        below = [i for i, (a, b) in enumerate(stored) if a == qe and b <= qt]
        above = [i for i, (a, b) in enumerate(stored) if a == qe and b >= qt]
        assert p == (below[-1] if below else -1)
        assert s == (above[0] if above else -1)


def brute_nearest(queries, candidates, tol):
    out = set()
    for q, qc, qt in queries:
        best = None
        for c, cc, ct in candidates:
            if None in (qc, qt, cc, ct) or qt != qt or ct != ct or qc.strip().lower() != cc.strip().lower():
                continue
            d = abs(round(qt * 1e6) - round(ct * 1e6))
            if d <= tol * 1e6 and (best is None or (d, c) < best):
                best = (d, c)
        if best:
            out.add((q, best[1], best[0]))
    return out


def test_nearest_against_brute_force(spark):
    r = random.Random(3)
    call = lambda: r.choice(["hot", "hot", "hot", "HOT ", "b", "c", None])
    time = lambda: r.choice([None, float("nan"), float("inf"), 600.0, 597.0, 603.0, -2.0] + [round(r.uniform(-5, 1300), r.choice([0, 1, 3])) for _ in range(20)])
    queries = [(i, call(), time()) for i in range(400)]
    candidates = [(i % 300, call(), time()) for i in range(400)]
    q = spark.createDataFrame(queries, "qid long, call string, t double").selectExpr("*", "'x' AS entity", "1 AS g")
    c = spark.createDataFrame(candidates, "cid long, call string, t double").selectExpr("*", "'y' AS block")
    args = dict(query_id="qid", candidate_id="cid", entity="call", time="t", tolerance_s=3.0, groups=5)
    got = [tuple(x) for x in nearest_in_time(q, c, **args).collect()]
    assert len(got) == len(set(got))
    ok = lambda rows: [x for x in rows if x[2] is None or abs(x[2]) != float("inf")]
    assert set(got) == brute_nearest(ok(queries), ok(candidates), 3)
    assert nearest_in_time(q.limit(0), c, **args).count() == 0
    assert nearest_in_time(q, c.limit(0), **args).count() == 0


def brute_runs(rows, gap):
    by = {}
    for i, c, t, s in rows:
        s = re.sub(r"[\W_]+", "", s.lower()) if s else ""
        if c is None or t is None or t != t or not s:
            continue
        k = (c, round(t * 1e6))
        if k in by:
            by[k] = (min(by[k][0], s), min(by[k][1], i))
        else:
            by[k] = (s, i)
    out, run = set(), None
    for (c, u), (s, i) in sorted(by.items()):
        if run and run[0] == c and run[1] == s and u - run[5] <= gap * 1e6:
            run[3], run[5] = run[3] + 1, u
        else:
            if run:
                out.add(tuple(run))
            run = [c, s, i, 1, u, u]
    if run:
        out.add(tuple(run))
    return out


def test_runs_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", "c", None]), r.choice([None, float("nan"), *[round(r.uniform(0, 300) * 2) / 2 for _ in range(30)]]), r.choice(["ivr", "IVR ", "<ivr>", "hold", "Hold.", None, "", " - "])) for i in range(3000)]
    # conflicting states at equal times take the smallest state
    df = spark.createDataFrame(rows, "rid long, call string, t double, state string").selectExpr("*", "0 AS piece", "'z' AS entity")
    want = brute_runs(rows, 5.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for chunks in (1, 7):
            got = [tuple(x) for x in collapse_runs(df, entity="call", time="t", state="state", row_id="rid", most_gap_s=5.0, chunks=chunks).select("entity", "state", "first_row_id", "events", "first_us", "last_us").collect()]
            assert len(got) == len(set(got))
            assert set(got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert collapse_runs(df.limit(0), entity="call", time="t", state="state", row_id="rid", most_gap_s=5.0).count() == 0


def test_one_run_over_many_chunks(spark):
    df = spark.range(5000).selectExpr("id AS rid", "'a' AS call", "id * 0.5 AS t", "'hold' AS state")
    got = collapse_runs(df, entity="call", time="t", state="state", row_id="rid", most_gap_s=5.0, chunks=9).collect()
    assert [(x["first_row_id"], x["events"]) for x in got] == [(0, 5000)]
