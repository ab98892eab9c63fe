"""Sequential folds: scripted transfers, filter invariants, causality, registry, silence, words, matching, speakers."""

import random

import numpy as np
import pytest

from callweave.operators import consensus, intervals, metrics, sequence as S, timeseries
from pyspark.sql import functions as F


def play(script, cfg=S.TransferConfig(), close=True):
    """script: (state, seconds, speaker, is_new, phrase, fail, leg); flags fire on the first hop of 0.5 s."""
    t, s, out, entered, before = 0.0, S.Transfer(), [], 0.0, None
    for state, seconds, speaker, new, phrase, fail, leg in script:
        for k in range(int(seconds / 0.5)):
            if state != before:
                entered, before = t, state
            out += S.transfer_step(s, S.Hop(t, state, speaker, new and k == 0, phrase * (k == 0), fail * (k == 0), 0.9, leg and k == 0, t - entered), cfg)
            t += 0.5
    if close:
        out += S.transfer_close(s)
    return out, s


def seg(state, seconds, speaker=None, new=False, phrase=0.0, fail=0.0, leg=False):
    return (state, seconds, speaker, new, phrase, fail, leg)


@pytest.mark.parametrize("script, outcomes", [
    ([seg("human", 6, "human_1"), seg("human", 2, "human_1", phrase=0.9), seg("hold", 10), seg("human", 8, "human_2", new=True)], ["completed"]),
    ([seg("human", 5, "human_1", phrase=0.9), seg("hold", 6), seg("ivr", 6)], ["completed"]),
    ([seg("human", 5, "human_1", phrase=0.9), seg("hold", 8), seg("human", 8, "human_1")], ["failed"]),
    ([seg("human", 4, "human_1", phrase=0.9), seg("human", 4, "human_1", fail=0.9)], ["failed"]),
    ([seg("human", 3, "human_1", phrase=0.9), seg("hold", 6)], ["failed"]),
    ([seg("ivr", 30)], []),
    ([seg("ivr", 8), seg("hold", 12), seg("human", 8, "human_1", new=True)], []),
])
def test_transfers(script, outcomes):
    events, s = play(script)
    assert [o for k, _, _, _, o in events if k == "transfer_end"] == outcomes
    assert sum(k == "transfer_start" for k, *_ in events) == len(outcomes) and s.phase == "idle"


def test_transfer_details():
    events, s = play([seg("human", 4, "human_1", phrase=0.9), seg("hold", 6), seg("ivr", 0.5), seg("hold", 6)], close=False)
    assert s.phase == "in_progress" and not [e for e in events if e[0] == "transfer_end"]
    events, _ = play([seg("human", 3, "human_1", phrase=0.9), seg("human", 25, "human_1")], S.TransferConfig(announce_s=10))
    assert [e[3] for e in events if e[0] == "transfer_end"] == ["no hold and nobody else in time"]
    events, _ = play([seg("human", 3, "human_1", leg=True)])
    assert "leg" in [e for e in events if e[0] == "transfer_start"][0][3]


def test_transfer_rules_are_complete():
    """Every rule names a known phase and condition; each phase can be left, and what closes has an outcome."""
    phases = {r.phase for r in S.TRANSFER_RULES}
    assert phases == {"idle", "announced", "in_progress"} and all(r.when in S.CONDITIONS and r.then in phases for r in S.TRANSFER_RULES)
    assert all((r.outcome is not None) == (r.then == "idle") and (r.confidence is None or r.confidence in S.CONFIDENCES) for r in S.TRANSFER_RULES)
    events, _ = play([seg("human", 4, "a", phrase=0.9), seg("hold", 5), seg("other", 260), seg("hold", 4)])
    assert [(e[3], e[4]) for e in events if e[0] == "transfer_end"] == [("it took too long", "failed")]


def test_filter_invariants():
    assert np.allclose(S.transition_matrix().sum(1), 1)
    f = S.Filter()
    for k in range(8):
        S.filter_step(f, k, [0.85, 0.05, 0.05, 0.05])
    assert S.STATES[S.filter_step(f, 8, [0.05, 0.85, 0.05, 0.05])[1]] == "ivr"
    for k in range(8):
        got = S.filter_step(f, 9 + k, [0.05, 0.85, 0.05, 0.05])
    assert S.STATES[got[1]] == "human"
    post, *_ = S.filter_step(f, 20, [0, 0, 0, 0])
    assert np.isfinite(post).all() and abs(sum(post) - 1) < 1e-9


def hop_rows(n=400, calls=("a", "b"), seed=1):
    r = random.Random(seed)
    return [(i, r.choice(calls), i * 0.5, r.choice(S.STATES), r.random(), r.choice([None, "human_1", "human_2"])) for i in range(n)]


def hop_frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, call_id string, t_s double, state string, confidence double, speaker_id string").withColumns({"sub_label": F.lit("x"), "latency_ms": F.lit(1.0)})


@pytest.mark.parametrize("operator", ["hmm", "boundary", "context", "previous"])
def test_nothing_ahead_is_read(spark, operator):
    rows = hop_rows()
    run = {"hmm": lambda d: S.hmm_filter(S.emissions(d)), "boundary": timeseries.boundary_events, "context": lambda d: timeseries.context_delta(d, "call_id", ["t_s"], ["confidence"]), "previous": timeseries.previous_distinct_state}[operator]
    before = lambda d: sorted(map(str, run(d).filter("t_s <= 100").collect()))
    assert before(hop_frame(spark, [x for x in rows if x[2] <= 100])) == before(hop_frame(spark, rows))


def test_segments_tile_the_call(spark):
    rows = [(1, "a", 0.5, "ivr", 0.9, None), (2, "a", 1.0, "ivr", 0.5, None), (3, "a", 1.5, "hold", 0.5, None), (4, "a", 2.0, "hold", 0.5, "human_9"), (5, "a", 2.5, "human", 0.5, None)]
    got = timeseries.segment_timeline(hop_frame(spark, rows), hop_s=0.0).orderBy("start_s").collect()
    assert [(x["start_s"], x["end_s"], x["state"]) for x in got] == [(0.5, 1.0, "ivr"), (1.5, 2.0, "hold"), (2.5, 2.5, "human")]
    assert got[0]["best_row"] == 1 and got[1]["speaker_id"] == "human_9"


def test_registry():
    a, b = np.eye(4)[0], np.eye(4)[1]
    r = S.Registry()
    assert r.observe(a)[::2] == (0, True)
    assert r.observe(b)[::2] == (0, False)  # one window is not enough
    assert r.observe(a)[::2] == (0, False)
    r.observe(b)
    assert r.observe(b)[::2] == (1, True)
    assert r.observe(np.zeros(4)) == (1, 0.0, False)


def test_silence_cuts():
    s, out = S.Silence(), []
    for k in range(700):
        speech = 20 <= k < 120 or 300 <= k
        out += S.silence_step(s, (k + 1) * 0.02, speech, 0.02)
    reasons = [x[2] for x in out]
    assert reasons[0] == "silence" or reasons[0] == "speech_onset"
    assert "max_length" in reasons
    assert all(abs(a[1] - b[0]) < 1e-9 for a, b in zip(out, out[1:]))


def test_words_are_given_once():
    text = [(0.2, "for"), (0.6, "claims"), (1.1, "press"), (1.6, "two")]
    h, got = S.Heard(), []
    for k in range(5):
        got += S.dedup_step(h, 2.0 + k * 0.5, [(t + 0.02 * k, w) for t, w in text])
    assert [w for _, w in got] == ["for", "claims", "press", "two"]


def test_greedy_pairs():
    assert S.greedy_pairs([(10.0, "x")], [(9.6, "x"), (10.4, "x"), (10.0, "y")], 1.0) == [(0, 0, pytest.approx(-0.4))]
    assert S.greedy_pairs([(1.0, "x"), (1.2, "x")], [(1.1, "x")], 1.0) == [(0, 0, pytest.approx(0.1))]


def test_matching_in_pieces_equals_whole(spark):
    r = random.Random(6)
    make = lambda n: [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *[round(r.uniform(0, 400), 1) for _ in range(9)]]), r.choice("xy"), r.choice([None, "ok", "no"])) for _ in range(n)]
    g, p = make(120), make(150)
    df = lambda rows: spark.createDataFrame(rows, "k string, t double, kind string, tag string")
    got = metrics.match_events(df(g), df(p), "k", 2.0).collect()
    for key in "ab":
        order = lambda rows: sorted([x for x in rows if x[0] == key and x[1] is not None], key=lambda x: (x[1], x[2], x[3] or ""))
        pairs = S.greedy_pairs([(x[1], x[2]) for x in order(g)], [(x[1], x[2]) for x in order(p)], 2.0)
        assert sum(x["k"] == key and x["gold_t"] is not None and x["pred_t"] is not None for x in got) == len(pairs)
    counts = metrics.match_counts(metrics.match_events(df(g[:0]), df(p[:0]), "k", 2.0), ()).first()
    assert counts["tp"] == 0 and counts["precision"] is None and counts["f1"] is None


def test_speaker_names():
    rows = [(0, "human", {"g": "h1", "p": "a"}), (1, "ivr", {}), (2, "human", {"g": "h2", "p": "b"}), (3, "human", {"g": "h1"}), (4, "human", {}), (5, "human", {"p": "b"})]
    assert {k: v[0] for k, v in consensus.name_speakers(rows).items()} == {0: "human_1", 2: "human_2", 3: "human_1", 4: "human_1", 5: "human_2"}
    assert consensus.name_speakers(rows)[2][1] == "2/2" and consensus.name_speakers(rows)[4][1] is None


def voting(spark):
    seg = [("A", 0, 0.0, 6.0, "ivr"), ("A", 1, 6.0, 10.0, "human"), ("B", 0, 0.0, 4.0, "ivr"), ("B", 1, 4.0, 10.0, "human"), ("C", 0, 0.0, 5.0, "ivr"), ("C", 1, 5.0, 6.0, "hold")]
    names = {"A": "gemini", "B": "gpt_audio", "C": "asr_llm"}
    s = spark.createDataFrame([("c", names[a], q, x, y, lab, None, 0.5, 10.0) for a, q, x, y, lab in seg], "call_id string, labeler string, seq int, start double, end double, label string, human_id string, confidence double, duration_s double")
    return s, spark.createDataFrame([("c", 10.0), ("e", 5.0)], "call_id string, duration_s double")


def test_vote_on_the_common_refinement(spark):
    got = {(x["call_id"], x["start"], x["end"]): (x["label"], round(x["agreement"], 3), x["n_voters"], x["tie"]) for x in consensus.vote_intervals(*voting(spark)).collect()}
    assert got == {("c", 0.0, 4.0): ("ivr", 1.0, 3, False), ("c", 4.0, 5.0): ("ivr", 0.667, 3, False), ("c", 5.0, 6.0): ("hold", 0.333, 3, True), ("c", 6.0, 10.0): ("human", 1.0, 2, False), ("e", 0.0, 5.0): ("unknown", 0.0, 0, False)}


def test_near_cuts_cascade(spark):
    s = spark.createDataFrame([("c", "x", i, a, b, "ivr", None, 0.5, 3.0) for i, (a, b) in enumerate([(0.0, 1.0), (1.02, 1.04), (1.06, 3.0)])], voting(spark)[0].schema)
    got = consensus.refinement_cuts(s, spark.createDataFrame([("c", 3.0)], "call_id string, duration_s double")).orderBy("k").collect()
    assert [(r["k"], r["cut"]) for r in got] == [(0, 0.0), (1, 1.0), (2, 1.06), (3, 3.0)]


def test_scale_and_chunks(spark):
    df = lambda ends, dur: spark.createDataFrame([("c", float(i), e, dur) for i, e in enumerate(ends)], "call_id string, start double, end double, duration_s double")
    scale = lambda ends, dur: intervals.unit_scale(df(ends, dur), ["call_id"]).first()["scale"]
    assert scale([1.0, 2.0, 4.59], 300.0) == 60 and scale([1.0, 4.59], 300.0) == 1 and scale([1.0, 2.0, 80.0], 300.0) == 1 and scale([1.0, 2.0, 6.0], 300.0) == 1
    plan = intervals.plan_chunks(spark.createDataFrame([("r", 601.8)], "k string, total double"), "k", "total").collect()
    assert [(x["start_s"], x["end_s"]) for x in plan] == [(0.0, 300.0), (300.0, 601.8)]


def test_interval_join_over_bins(spark):
    r = random.Random(3)
    pts = [(r.choice("ab"), r.uniform(0, 500)) for _ in range(200)]
    iv = [(r.choice("ab"), a, a + r.uniform(0, 200), i) for i, a in enumerate(r.uniform(0, 400) for _ in range(60))]
    p, i = spark.createDataFrame(pts, "k string, t double"), spark.createDataFrame(iv, "k string, start double, end double, n long")
    got = sorted((x["k"], x["t"], x["n"]) for x in intervals.interval_join(p, i, ["k"], "t").collect())
    assert got == sorted((k, t, n) for k, t in pts for c, a, b, n in iv if c == k and a <= t < b)


def test_transfer_denied_in_words(spark):
    """A phrase that denies an announced transfer, heard within half a second before a hop, closes it as failed; a speaker is new once."""
    from callweave.plans.catalog import transfer_inputs

    hops = spark.createDataFrame([("c", i, i * 0.5, "human", "a" if i < 12 else "b", 0.9) for i in range(20)], "call_id string, row_id long, t_s double, state string, speaker_id string, confidence double")
    carrier = spark.createDataFrame([], "call_id string, t_s double, kind string")
    spoken = spark.createDataFrame([("c", 1.0, "phrase", None), ("c", 2.9, "fail", 0.75)], "call_id string, t_s double, kind string, fail double")
    rows = transfer_inputs(hops, carrier, spoken)
    assert [r["row_id"] for r in rows.filter("is_new").orderBy("row_id").collect()] == [0, 12]
    assert [(r["t_s"], r["transfer_fail"]) for r in rows.filter("transfer_fail > 0").collect()] == [(3.0, 0.75)]
    ends = [(r["t_s"], r["evidence"], r["outcome"]) for r in S.transfer_events(rows).filter("event_type = 'transfer_end'").collect()]
    assert ends == [(3.0, "it was said that there will be none", "failed")]
