"""Units and coverage against brute force, with nulls, NaN, ties, repeats, empty tables and extra columns."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.operators import units
from callweave.operators.coverage import IntervalMap, interval_coverage

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("said, unit", [("sec", "s"), ("S", "s"), ("secs.", "s"), ("Min.", "min"), ("m", "min"), ("MS", "ms"), ("millis", "ms"), ("h", "h"), ("hrs", "h"), ("frame (20 ms)", "frame20"), ("20ms frames", "frame20"), ("cells of 250ms", "cell250"), ("grid250ms", "cell250"), ("8 kHz samples", "sample8k"), ("samples@8kHz", "sample8k"), ("Zeiten in Minuten, dezimal.", "min"), ("tiempos en milisegundos", "ms"), ("quarter-second cells, from zero", "cell250"), ("Times are fractions of an hour.", "h"), ("The piece opens with a menu.", None), ("", None), (None, None)])
def test_units_named(spark, said, unit):
    assert spark.createDataFrame([(said,)], "t string").select(units.unit_named(F.col("t"))).first()[0] == unit


@pytest.mark.parametrize("text, want", [("0:00.000 / 0:44.441", (0, 44441)), ("2m11.169s–2m15.572s", (131169, 135572)), ("from 208.481 seconds..216.520 seconds", (208481, 216520)), ("2 min 42.573 s-->3 min 32.134 s", (162573, 212134)), ("225165ms..238292ms", (225165, 238292)), ("from PT0M43.145S to PT2M36.955S", (43145, 156955)), ("02:36,010 to 02:40,786", (156010, 160786)), ("99,600s..100,675s", (99600, 100675)), ("t=0 min 42.685 s-->0 min 50.973 s", (42685, 50973)), ("from 0:00:49.830 to 0:01:00.531", (49830, 60531)), ("01:02:03.5 - 01:02:04", (3723500, 3724000)), ("garbage", (None, None)), ("5s", (5000, None))])
def test_written_ranges(spark, text, want):
    lo, hi = units.time_range_ms(F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(F.round(lo).cast("bigint"), F.round(hi).cast("bigint")).first()
    assert tuple(got) == want


def raw(spark, rows):
    schema = "raw_id long, result_id long, call_id string, labeler string, seq int, seg_start double, seg_end double, time_text string, time_unit string, raw_response string, label string, confidence double"
    return spark.createDataFrame(rows, schema).withColumn("unit", F.lit("clash"))


def chunk_frame(spark, calls):
    return spark.createDataFrame([(c, d) for c, d in calls.items()], "chunk_id string, duration_s double").withColumn("label", F.lit("clash"))


def test_units_end_to_end(spark):
    calls = {f"c{i}": 300.0 for i in range(60)} | {"none": None}
    rows, want = [], set()

    def add(result, seq, a, b, text=None, unit=None, said=None, call=None):
        rows.append((len(rows), result, call or f"c{result % 60}", "x", seq, a, b, text, unit, said, "ivr", 0.5))

    for r in range(60):  # stated units: what the forest learns from
        f, said = [(1, "seconds"), (1 / 60, "minutes"), (1000, "milliseconds")][r % 3]
        for k in range(4):
            add(r, k, 70.0 * k * f, 70.0 * (k + 1) * f, unit=said)
            if f != 1:
                want.add((r, k, round(70_000 * k), round(70_000 * (k + 1))))
    for r, f in ((100, 1 / 60), (101, 1000.0), (102, 1.0)):  # nothing stated: by the extent
        add(r, 0, 0.0, 150 * f)
        add(r, 1, 150 * f, 295 * f)
        if f != 1:
            want |= {(r, 0, 0, 150_000), (r, 1, 150_000, 295_000)}
    add(103, 0, 1.0, 2.0)  # fits nothing: seconds
    add(104, 0, 60.0, 120.0, said="Positions count cells of 250 ms.")
    want.add((104, 0, 15_000, 30_000))
    add(104, 1, 60.0, 120.0, said=None)  # the result's other row says it
    want.add((104, 1, 15_000, 30_000))
    add(105, 0, None, None, text="0:01.5 / 0:02.25")
    want.add((105, 0, 1500, 2250))
    rows.append((len(rows), 105, "c1", "x", 0, None, None, "0:01.5 / 0:02.25", None, None, "ivr", 0.5))  # sent again
    add(106, 0, NAN, 2.0, unit="ms")
    add(106, 1, 1.0, INF, unit="ms")
    add(107, 0, 1.0, 4.9, call="none")
    got = units.foreign_unit_segments(raw(spark, rows), chunk_frame(spark, calls)).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == want
    every = units.common_units(raw(spark, rows), chunk_frame(spark, calls))
    assert every.filter("result_id = 103").first()["start_ms"] == 1000
    assert units.units_for_review(raw(spark, rows), chunk_frame(spark, calls)).filter("result_id = 103").count() == 1


def test_units_of_empty_tables(spark):
    r, c = raw(spark, [(0, 0, "c", "x", 0, 1.0, 2.0, None, "ms", None, "ivr", 0.1)]), chunk_frame(spark, {"c": 3.0})
    assert units.foreign_unit_segments(r.limit(0), c).count() == 0
    assert units.foreign_unit_segments(r, c.limit(0)).count() == 1


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20)), max_size=40), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_interval_map(pairs, within):
    m = IntervalMap(join_within=within)
    for a, n in pairs:
        m.insert(a, a + n)
    want = []
    for a, b in sorted((a, a + n) for a, n in pairs):
        if want and a - want[-1][1] <= within:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert [list(x) for x in m.periods()] == want


def brute_coverage(rows, extents):
    out = set()
    for call in {r[0] for r in rows if r[0] is not None}:
        dur = extents.get(call)
        cut = []
        for c, a, b in rows:
            if c == call and a is not None and b is not None and a == a and b == b and abs(a) < INF and abs(b) < INF and b > a:
                a, b = max(round(a * 1e6), 0), round(b * 1e6) if dur is None else min(round(b * 1e6), round(dur * 1e6))
                if b > a:
                    cut.append((a, b))
        if not cut:
            continue
        periods = []
        for a, b in sorted(cut):
            if periods and a - periods[-1][1] < 50_000:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        at = 0
        for a, b in periods:
            out.add((call, "period", round(a / 1e3), round(b / 1e3)))
            if a - at >= 50_000:
                out.add((call, "gap", round(at / 1e3), round(a / 1e3)))
            at = b
        if dur is not None and round(dur * 1e6) - at >= 50_000:
            out.add((call, "gap", round(at / 1e3), round(dur * 1e3)))
    return out


def test_coverage_against_brute_force(spark):
    r = random.Random(8)
    extents = {"hot": 300.0, "a": 20.0, "b": None, "d": 5.0}
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", "lost", None]), r.choice([None, NAN, -INF, -0.5, *[round(r.uniform(0, 305), 2) for _ in range(25)]]), None) for _ in range(900)]
    rows = [(c, a, r.choice([None, NAN, INF, a, *[round((a if a is not None and a == a and abs(a) < INF else 1) + r.uniform(-1, 2), 2) for _ in range(20)]])) for c, a, _ in rows]
    rows += [("a", 1.0, 2.0), ("a", 2.05, 3.0), ("a", 3.049, 4.0), ("d", 6.0, 7.0)]
    df = spark.createDataFrame(rows, "call string, s double, e double").withColumn("entity", F.lit("clash"))
    ext = spark.createDataFrame(list(extents.items()), "id string, dur double").withColumn("call", F.lit("clash"))
    got = [tuple(x) for x in interval_coverage(df, ext, "call", "s", "e", "id", "dur").collect()]
    assert len(got) == len(set(got))
    want = brute_coverage(rows, extents)
    assert set(got) == want
    assert "d" not in {x[0] for x in got}  # its only segment lies outside
    assert interval_coverage(df.limit(0), ext, "call", "s", "e", "id", "dur").count() == 0


def test_the_forest_decides(spark):
    """A confident answer converts if it passes the exact check and else leaves the default; another forest gives other rows, an unsure one leaves them to the check and to review."""
    rows = [(0, 1, "c", "x", 0, 0.0, 4.9, None, None, None, "ivr", 0.5), (1, 2, "c", "x", 0, 0.0, 290_000.0, None, None, None, "ivr", 0.5), (2, 3, "c", "x", 0, 0.0, 10.0, None, None, None, "ivr", 0.5)]
    df, calls = raw(spark, rows), chunk_frame(spark, {"c": 300.0})
    answers = lambda unit, confidence: lambda train, config: lambda asked: asked.withColumns({"proposed": F.lit(unit), "confidence": F.lit(confidence)})
    found = lambda unit, confidence: {tuple(x) for x in units.foreign_unit_segments(df, calls, fit=answers(unit, confidence)).collect()}
    assert found("min", 0.99) == {(1, 0, 0, 294_000)}
    assert found("ms", 0.99) == {(2, 0, 0, 290_000)}
    assert found("s", 0.99) == set()
    assert found("s", 0.4) == {(1, 0, 0, 294_000), (2, 0, 0, 290_000)}
    review = lambda unit, confidence: {x["result_id"] for x in units.units_for_review(df, calls, fit=answers(unit, confidence)).collect()}
    assert review("min", 0.99) == {2, 3} and review("min", 0.4) == {1, 2, 3}
