"""Whole calls: text and flags of every hop against a plain loop, nothing ahead is read, the fold's state as JSON, the report and the trained head."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions import lexicon
from callweave.operators import engine, models, sequence as S
from callweave.sources import synth, wav

CFG = engine.EngineConfig()


@pytest.fixture(scope="module")
def made():
    return {"t": synth.make_call("transfer", 5), "f": synth.make_call("failed_transfer", 11)}


def frames(spark, made, until=None):
    cut = lambda c: c["audio"] if until is None else c["audio"][: int(until * synth.SR)]
    calls = spark.createDataFrame([(k, bytearray(wav.encode_pcm16(cut(c), synth.SR))) for k, c in made.items()], "call_id string, wav binary")
    script = spark.createDataFrame([(k, a, b, line) for k, c in made.items() for a, b, line in c["script"]] + [("t", 1.0, None, "lost"), (None, 1.0, 2.0, "lost")], "call_id string, start_s double, end_s double, text string")
    carrier = spark.createDataFrame([(k, t, kind) for k, c in made.items() for t, kind, _ in c["telephony"]] + [("t", None, "dtmf")], "call_id string, t_s double, kind string")
    return calls, script, carrier


@pytest.fixture(scope="module")
def tracked(spark, made):
    return engine.track_calls(*frames(spark, made))


def test_text_and_flags_against_a_plain_loop(spark, made, tracked):
    obs = {k: sorted((r for r in tracked.observations.collect() if r["call_id"] == k), key=lambda r: r["t_s"]) for k in made}
    for call, rows in obs.items():
        assert [r["hop"] for r in rows] == list(range(len(rows))) and len(rows) > 90
        words = [(a + i * (b - a) / n, a + (i + 1) * (b - a) / n, w) for a, b, line in made[call]["script"] for n in [len(line.split())] for i, w in enumerate(line.split())]
        heard, memory, last_asr, agent = [], S.Heard(), -1e9, None
        for r in rows:
            t = r["t_s"]
            if t - last_asr + 1e-9 >= CFG.asr_hop_s:
                last_asr = t
                if r["speech_prob"] >= CFG.asr_speech:
                    window = [(s, w) for s, _, w in words if max(0.0, t - CFG.asr_window_s) <= s < t]
                    heard += [(t, s, next(e for s2, e, w2 in words if (s2, w2) == (s, w)), w) for s, w in S.dedup_step(memory, t, window)]
            text = " ".join(w for _, s, e, w in heard if e >= t - CFG.text_s)
            assert r["text"] == text
            assert abs(r["raw_word_rate"] - sum(e >= t - CFG.rate_s for _, _, e, _ in heard) / CFG.rate_s) < 1e-9
            agent = t if r["agent_speaking"] else agent
            assert r["agent_recently_spoke"] == float(agent is not None and t - agent <= 3.0 + 1e-9)
            legs = [x for x, kind, _ in made[call]["telephony"] if x <= t]
            assert r["leg_recent"] == bool(legs and t - legs[-1] <= 3.0)


def test_hops_events_and_summary(made, tracked):
    hops = tracked.hops.toPandas()
    assert hops.groupby("call_id").size().to_dict() == {k: int((len(c["audio"]) / synth.SR - 0.02) / 0.5 + 1e-9) + 1 for k, c in made.items()}
    assert np.allclose(hops[["p_ivr", "p_human", "p_hold", "p_other"]].sum(axis=1), 1, atol=1e-5)
    events = tracked.events.toPandas()
    ends = events[events["event_type"] == "transfer_end"].groupby("call_id")["outcome"].apply(list).to_dict()
    assert "completed" in ends["t"] and ends["f"][-1] == "failed"
    assert (events[events["event_type"] == "transfer_start"].groupby("call_id").size() == events[events["event_type"] == "transfer_end"].groupby("call_id").size()).all()
    assert tracked.summary.count() == 2 and tracked.segments.count() > 8


def test_nothing_ahead_is_read(spark, made, tracked):
    one = {"t": made["t"]}
    early = engine.track_calls(*frames(spark, one, until=20.0)).hops.drop("latency_ms").filter("t_s < 19").orderBy("t_s").collect()
    whole = tracked.hops.filter("call_id = 't' AND t_s < 19").drop("latency_ms").orderBy("t_s").collect()
    assert len(early) > 30 and early == whole


def test_state_as_json(tracked):
    rows = [list(r) for r in tracked.observations.filter("call_id = 't'").orderBy("t_s").select(*engine.TRACK_COLUMNS).collect()]
    straight, saved, a, b = engine.Track(), None, [], []
    for row in rows:
        a += [x[:-1] for x in engine.track_step(straight, list(row))]
        state = engine.Track.loads(saved)
        b += [x[:-1] for x in engine.track_step(state, list(row))]
        saved = state.dumps()
        json.loads(saved)
    assert a == b and engine.track_close(straight) == engine.track_close(engine.Track.loads(saved))


def test_report_and_head(spark, made, tracked, tmp_path):
    turns = spark.createDataFrame([(k, i, a, b, state) for k, c in made.items() for i, (a, b, state, _, _) in enumerate(c["turns"])], "call_id string, turn_id int, start_s double, end_s double, state string")
    events = spark.createDataFrame([(k, t, kind, o) for k, c in made.items() for kind, t, o in c["events"]], "call_id string, t double, kind string, tag string")
    got = {(r["section"], r["name"]): r["value"] for r in engine.report(tracked, turns, events).collect()}
    assert got["states", "all accuracy"] > 0.6 and got["transfers", "transfer_start fn"] == 0 and got["transfers", "transfer_end fn"] == 0
    assert got["transfers", "transfer_start outcome_accuracy"] is None and got["boundaries", "2.0 recall"] >= got["boundaries", "0.5 recall"]
    rows = engine.training_rows(tracked.observations, turns).cache()
    head = models.Head.fit(rows, models.SCALARS, "y").with_temperature(rows, "y")
    head.save(str(tmp_path / "head.json"))
    assert models.Head.load(str(tmp_path / "head.json")) == head
    names = F.element_at(F.array(*map(F.lit, S.STATES)), F.col("y") + 1)
    assert head.predict(rows).select(F.avg((F.col("state") == names).cast("double"))).first()[0] > 0.9
    assert set(lexicon.FAMILIES) == {"ivr", "hold", "transfer", "transfer_fail", "human"}
