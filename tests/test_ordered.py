"""Bins of time against brute force: a key that holds most rows, narrow bins, empty bins, ties, nulls, negative times, empty tables, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions import lexicon, text
from callweave.operators import ordered

SCHEMA = "k string, t double, row long, v string, x double"


def rows(n=600, seed=3):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "hot", "a", "b"]), round(r.choice([r.uniform(-20, 90), r.uniform(400, 420), float(r.randrange(-3, 60))]), 1), i, r.choice([None, "u", "u", "u", "w"]), r.choice([None, *[round(r.uniform(-5, 5), 1) for _ in range(4)]])) for i in range(n)]


@pytest.fixture(scope="module")
def data():
    return rows()


def by_key(data):
    return {k: sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[2])) for k in {x[0] for x in data}}


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("clash", F.lit("clash"))


@pytest.mark.parametrize("width", [3.0, 50.0, 600.0])
def test_before_runs_and_sums(spark, data, width):
    df, keys, order = frame(spark, data), ["k"], ["t", "row"]
    last = {r["row"]: r["p"] for r in ordered.before(df, keys, order, {"p": F.col("v")}, width).collect()}
    run = {r["row"]: r["_run"]["row"] for r in ordered.runs(df, keys, order, F.col("v"), width).collect()}
    sums = {r["row"]: round(r["s"], 6) for r in ordered.sums_so_far(df, keys, order, {"s": F.col("x")}, width).collect()}
    assert len(last) == len(run) == len(sums) == len(data)
    for rs in by_key(data).values():
        seen, total, start = None, 0.0, None
        for i, (_, _, row, v, x) in enumerate(rs):
            if i == 0 or rs[i - 1][3] != v:
                start = row
            total += x or 0.0
            assert (last[row], run[row], sums[row]) == (seen, start, round(total, 6))
            seen = v if v is not None else seen


@pytest.mark.parametrize("width, k", [(3.0, 4), (40.0, 7), (600.0, 2)])
def test_rows_and_times_before(spark, data, width, k):
    df = frame(spark, data)
    got = ordered.with_last_rows(df, ["k"], ["t", "row"], k, width).collect()
    recent = ordered.with_recent(df, ["k"], "t", 2.5, width).collect()
    assert sum(not r["_halo"] for r in got) == sum(not r["_halo"] for r in recent) == len(data)
    near = lambda found: {key: {r["row"] for r in found if (r["k"], r["_bin"]) == key} for key in {(r["k"], r["_bin"]) for r in found}}
    last, late = near(got), near(recent)
    for key, rs in by_key(data).items():
        for i, x in enumerate(rs):
            at = (key, int(np.floor(x[1] / width)))
            assert {y[2] for y in rs[max(0, i - k) : i + 1]} <= last[at]
            assert {y[2] for y in rs if x[1] - 2.5 < y[1] <= x[1]} <= late[at]


def test_exact_percentiles_and_ranks(spark, data):
    df = frame(spark, [*data, (None, 1.0, 9_000, None, 2.5), (None, 1.0, 9_001, None, 7.5), ("null", 1.0, 9_002, None, None)])
    got = {r["k"]: r for r in ordered.percentiles(df, ["k"], "x", {"a": 0.5, "b": 0.95}).collect()}
    ranks = {r["k"]: r for r in ordered.ranked_values(df, ["k"], "x", {"m": F.floor(F.col("_n") / 2)}).collect()}
    assert set(got) == {"hot", "a", "b", None} and got[None]["a"] == 5.0
    for key, rs in by_key(data).items():
        xs = sorted(x[4] for x in rs if x[4] is not None)
        assert abs(got[key]["a"] - np.percentile(xs, 50)) < 1e-9 and abs(got[key]["b"] - np.percentile(xs, 95)) < 1e-9
        assert ranks[key]["m"] == xs[len(xs) // 2] and ranks[key]["_n"] == len(xs)


def test_empty_tables(spark, data):
    df = frame(spark, data).limit(0)
    assert ordered.before(df, ["k"], ["t"], {"p": F.col("v")}).count() == ordered.runs(df, ["k"], ["t"], F.col("v")).count() == 0
    assert ordered.with_last_rows(df, ["k"], ["t"], 3).count() == ordered.percentiles(df, ["k"], "x", {"a": 0.5}).count() == 0


def test_no_window_has_a_key_alone(spark, data):
    """Every window over rows is partitioned by key and bin; the only ones over a key alone see one row a bin."""
    plan = ordered.runs(frame(spark, data), ["k"], ["t", "row"], F.col("v"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bin" in line for line in windows)


@pytest.mark.parametrize("family, said", [("ivr", "Thank you for calling."), ("ivr", "For claims, press 2."), ("hold", "Thanks for holding!"), ("transfer", "Okay, I'll transfer you."), ("transfer_fail", "Sorry about that, let me help."), ("human", "Let me check.")])
def test_phrase_families(spark, family, said):
    t = spark.createDataFrame([(said,), ("the invoice was paid in march",), (None,), ("",)], "t string").select(text.normalize(F.col("t")).alias("n"))
    hit, *misses = [r[0] for r in t.select(text.phrase_score(F.col("n"), lexicon.FAMILIES[family])).collect()]
    assert hit >= 0.75 and misses == [0.0] * 3
