"""Tracking whole calls: sound, words, speakers and carrier signals to states, events, segments and summaries.

One plan over all calls: acoustic windows and phrase scores are map side; recognised words are joined to hops over time
bins; evidence is a projection; only what is sequential (speakers, filter, commitment, transfers) is one ordered fold, whose
step is the same in batch and stream. A hop sees nothing of what comes after it.

calls: (call_id, wav), script: (call_id, start_s, end_s, text) of recognised utterances, carrier: (call_id, t_s, kind).
Nulls: rows without call or time are left out; hops without words have an empty text.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import lexicon, text
from callweave.operators import metrics, models, sequence as S, timeseries
from callweave.operators.acoustics import FEATURES, window_features
from callweave.operators.intervals import interval_join
from callweave.session import cut


@dataclass(frozen=True)
class EngineConfig:
    """Cadence and windows in seconds, and the gates before recognition and before speakers."""

    hop_s: float = 0.5
    asr_hop_s: float = 1.0
    asr_window_s: float = 3.0
    asr_speech: float = 0.12
    text_s: float = 4.0
    rate_s: float = 5.0
    human_speech: float = 0.35
    human_music: float = 0.6
    human_prompt: float = 0.6
    voice_speech: float = 0.5
    recent_s: float = 3.0
    change_scale: float = 0.30


def scripted_words(script: DataFrame) -> DataFrame:
    """(call_id, start_s, end_s, word, i): the words of an utterance spread evenly over it."""
    words = script.filter("text IS NOT NULL AND call_id IS NOT NULL AND end_s > start_s").withColumn("w", F.split(F.trim("text"), r"\s+")).withColumn("n", F.size("w"))
    each = words.select("call_id", "start_s", (F.col("end_s") - F.col("start_s")).alias("d"), "n", F.posexplode("w").alias("i", "word")).filter("word != ''")
    return each.select("call_id", (F.col("start_s") + F.col("i") * F.col("d") / F.col("n")).alias("start_s"), (F.col("start_s") + (F.col("i") + 1) * F.col("d") / F.col("n")).alias("end_s"), "word", "i")


def heard_words(hops: DataFrame, script: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(call_id, heard_s, start_s, end_s, word): what overlapping recognition windows give out, once each, at the hop that heard it. Recognition runs every asr_hop_s, where there is speech."""
    every = max(1, round(cfg.asr_hop_s / cfg.hop_s))
    asked = hops.filter((F.col("hop") % every == 0) & (F.col("speech_prob") >= cfg.asr_speech)).select("call_id", F.greatest(F.col("t_s") - cfg.asr_window_s, F.lit(0.0)).alias("w0"), F.col("t_s").alias("w1"))
    at = interval_join(scripted_words(script), asked, ["call_id"], "start_s", "w0", "w1")
    windows = at.groupBy("call_id", "w1").agg(F.array_sort(F.collect_list(F.struct("start_s", "i", "end_s", "word"))).alias("words"))

    def step(h: S.Heard, row: list) -> list[tuple]:
        end, words = row
        length = {(w["start_s"], w["word"]): w["end_s"] for w in words}
        return [(end, s, length[s, w], w) for s, w in S.dedup_step(h, end, [(w["start_s"], w["word"]) for w in words])]

    return S.ordered_fold(windows, "call_id", ["w1"], ["w1", "words"], S.Heard, step, None, "call_id string, heard_s double, start_s double, end_s double, word string")


def with_text(hops: DataFrame, words: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """hops with the text of the last text_s and the rate of words over the last rate_s, of words heard by then."""
    reach = max(cfg.text_s, cfg.rate_s)
    spans = words.select("call_id", "heard_s", "start_s", "end_s", "word", (F.col("end_s") + reach + 1e-9).alias("until")).filter("until > heard_s")
    hit = interval_join(hops.select("call_id", "hop", "t_s"), spans, ["call_id"], "t_s", "heard_s", "until")
    late = lambda s: F.col("end_s") >= F.col("t_s") - s
    said = F.array_sort(F.collect_list(F.when(late(cfg.text_s), F.struct("heard_s", "start_s", "word"))))
    got = hit.groupBy("call_id", "hop").agg(F.array_join(F.transform(said, lambda x: x["word"]), " ").alias("text"), (F.count_if(late(cfg.rate_s)) / cfg.rate_s).alias("word_rate"))
    return hops.join(got, ["call_id", "hop"], "left").fillna({"text": "", "word_rate": 0.0})


def observations(calls: DataFrame, script: DataFrame, carrier: DataFrame, cfg: EngineConfig = EngineConfig(), timed: bool = False) -> DataFrame:
    """One row per call and hop: acoustic scores, voice, text, phrase scores, carrier flags, the named scalars and the evidence b0..b3 of the prior model."""
    hops = cut(window_features(calls, hop_s=cfg.hop_s, timed=timed).drop("audio").withColumn("hop", F.round((F.col("t_s") - 0.02) / cfg.hop_s).cast("int")))
    spoken = with_text(hops, heard_words(hops, script, cfg), cfg)
    normal = text.normalize(F.col("text"))
    scored = spoken.withColumns({
        "ivr_prompt_prob": text.phrase_score(normal, lexicon.IVR), "hold_phrase_prob": text.phrase_score(normal, lexicon.HOLD), "transfer_phrase_prob": text.phrase_score(normal, lexicon.TRANSFER),
        "transfer_fail_prob": text.phrase_score(normal, lexicon.TRANSFER_FAIL), "human_spontaneous_prob": text.spontaneous_score(normal, text.tokens(F.col("text")), lexicon.HUMAN, lexicon.MARKERS),
    })
    own = hops.select("call_id", "t_s", F.explode(F.array_compact(F.array(F.when(F.col("keys") != "", "dtmf"), F.when(F.col("agent_speaking"), "agent")))).alias("kind"))
    signals = carrier.filter("call_id IS NOT NULL AND t_s IS NOT NULL").select("call_id", "t_s", timeseries.state_name(F.col("kind")).alias("kind")).unionByName(own)
    flagged = timeseries.asof_flags(scored, signals, "call_id", "t_s", {"leg": ("siplegchanged", "participantchanged"), "dtmf": ("dtmf",), "agent": ("agent",)}, cfg.recent_s)
    ready = flagged.withColumns({"dtmf_recent": F.col("dtmf_recent").cast("double"), "sip_leg_changed": F.col("leg_recent").cast("double"), "agent_recently_spoke": F.col("agent_recent").cast("double"), "time_since_agent_spoke": F.col("since_agent_s"), "asr_confidence": F.when(F.col("text") != "", 0.95).otherwise(0.0), "raw_word_rate": F.col("word_rate")})
    named = models.prior_evidence(models.clipped_scalars(ready))
    return named.withColumns({f"b{i}": F.col(f"p_{s}") for i, s in enumerate(S.STATES)}).drop("state", *[f"p_{s}" for s in S.STATES])


@dataclass
class Track:
    """What a call's fold remembers: speakers, the voice before, filter and transfer."""

    speakers: S.Registry = field(default_factory=S.Registry)
    voice: list[float] | None = None
    filter: S.Filter = field(default_factory=S.Filter)
    transfer: S.Transfer = field(default_factory=S.Transfer)

    def dumps(self) -> str:
        r = self.speakers
        return json.dumps([r.centroids.tolist(), r.windows.tolist(), r.active, None if r.candidate is None else list(map(float, r.candidate)), r.agreed, self.voice, asdict(self.filter), asdict(self.transfer)])

    @classmethod
    def loads(cls, s: str | None) -> Track:
        t = cls()
        if s:
            centroids, windows, t.speakers.active, candidate, t.speakers.agreed, t.voice, f, x = json.loads(s)
            t.speakers.centroids, t.speakers.windows = np.array(centroids) if centroids else np.zeros((0, 0)), np.array(windows)
            t.speakers.candidate = None if candidate is None else np.array(candidate)
            t.filter, t.transfer = S.Filter(**f), S.Transfer(**x)
        return t


TRACK_COLUMNS = ["t_s", "hop", "b0", "b1", "b2", "b3", "voice", "speech_prob", "music_prob", "ivr_prompt_prob", "transfer_phrase_prob", "transfer_fail_prob", "leg_recent"]
EVENT = "struct<event_type:string,t_s:double,confidence:double,evidence:string,outcome:string>"
TRACK_SCHEMA = f"call_id string, t_s double, hop int, speaker_id string, similarity double, change_prob double, is_new boolean, p_ivr double, p_human double, p_hold double, p_other double, state string, confidence double, dwell_s double, transfer_in_progress boolean, events array<{EVENT}>, fold_ms double"


def hear_speaker(s: Track, voice: np.ndarray, cfg: EngineConfig) -> tuple[int, float, float, bool]:
    """(speaker's number, similarity, probability of a change, new) of a window of human speech."""
    before = s.speakers.active
    who, similarity, new = s.speakers.observe(voice)
    change = min(1.0, max(0.0, (1 - S.cosine(voice, np.array(s.voice))) / cfg.change_scale)) if s.voice is not None else 0.0
    if new or (who >= 0 <= before != who):
        change = max(change, 0.9)
    s.voice = [float(x) for x in voice]
    return who, similarity, change, new


def track_step(s: Track, row: list, cfg: EngineConfig = EngineConfig(), transfers: S.TransferConfig = S.TransferConfig()) -> list[tuple]:
    began = time.perf_counter()
    t, hop, *b, voice, speech, music, prompt, phrase, fail, leg = row
    who, similarity, change, new = s.speakers.active, 0.0, 0.0, False
    # only human speech is asked for its speaker: music and prompts would be taken for persons
    if speech > cfg.human_speech and music < cfg.human_music and prompt < cfg.human_prompt and speech >= cfg.voice_speech:
        who, similarity, change, new = hear_speaker(s, np.asarray(voice, float), cfg)
    speaker = f"human_{who + 1}" if who >= 0 else None
    post, state, p, dwell = S.filter_step(s.filter, t, list(b))
    events = S.transfer_step(s.transfer, S.Hop(t, S.STATES[state], speaker, new, phrase, fail, p, bool(leg), dwell), transfers)
    shown = [dict(zip(("event_type", "t_s", "confidence", "evidence", "outcome"), (k, at, round(c, 6), e, o))) for k, at, c, e, o in events]
    return [(t, int(hop), speaker, round(similarity, 6), round(change, 6), new, *(round(x, 6) for x in post), S.STATES[state], round(p, 6), round(dwell, 3), s.transfer.phase != "idle", shown, round((time.perf_counter() - began) * 1000, 4))]


def track_close(s: Track) -> list[tuple]:
    """A row without a hop that closes an open transfer."""
    ends = S.transfer_close(s.transfer)
    return [(ends[0][1], None, *[None] * 12, [dict(zip(("event_type", "t_s", "confidence", "evidence", "outcome"), e)) for e in ends], None)] if ends else []


@dataclass
class Tracked:
    """observations, hops, events, segments and summary of all calls."""

    observations: DataFrame
    hops: DataFrame
    events: DataFrame
    segments: DataFrame
    summary: DataFrame


def track_calls(calls: DataFrame, script: DataFrame, carrier: DataFrame, cfg: EngineConfig = EngineConfig(), timed: bool = False) -> Tracked:
    """The whole pipeline; observations and hops are written once and used by what follows."""
    obs = cut(observations(calls, script, carrier, cfg, timed))
    rows = cut(S.ordered_fold(obs, "call_id", ["t_s"], TRACK_COLUMNS, Track, lambda s, row: track_step(s, row, cfg), track_close, TRACK_SCHEMA))
    events = rows.select("call_id", F.explode("events").alias("e")).select("call_id", "e.*")
    spent = F.round(F.col("acoustic_ms") + F.col("fold_ms"), 4) if timed else F.col("fold_ms")
    why = rows.filter("hop IS NOT NULL").drop("events", "t_s").join(obs, ["call_id", "hop"])
    sub = text.sub_label(F.col("state"), F.col("music_prob"), F.col("speech_prob"), F.col("silence_prob"), F.col("tone_prob"), F.col("human_spontaneous_prob"), F.col("text"), F.col("ivr_prompt_prob"))
    hops = why.select("call_id", "t_s", "hop", "state", "confidence", "p_ivr", "p_human", "p_hold", "p_other", "dwell_s", "speaker_id", "similarity", "change_prob", "is_new", "text", "transfer_in_progress", spent.alias("latency_ms"), sub.alias("sub_label"), models.evidence(F.col("state"), F.col("text")).alias("evidence"), F.col("hop").cast("bigint").alias("row_id"))
    segments = timeseries.segment_timeline(hops, hop_s=cfg.hop_s)
    return Tracked(obs, hops, events, segments, metrics.call_summary(segments, hops, cfg.hop_s * 1000))


def report(tracked: Tracked, gold_turns: DataFrame, gold_events: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(section, name, value) over all calls together: hops are pooled, hits and misses summed, recall weighted by boundaries. Where there is nothing to score the value is NULL.

    gold_turns: (call_id, turn_id, start_s, end_s, state), gold_events: (call_id, t, kind, tag).
    """
    pairs = metrics.gold_at(tracked.hops.select("call_id", "row_id", "t_s", "state", "confidence").withColumn("row_id", F.concat_ws("/", "call_id", "row_id")), gold_turns).filter("gold_state IS NOT NULL")
    pairs = cut(pairs)

    def long(df: DataFrame, section: str, key: str | None, names: list[str]) -> DataFrame:
        label = lambda n: F.concat(F.coalesce(F.col(key).cast("string"), F.lit("all")), F.lit(f" {n}")) if key else F.lit(n)
        return df.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), label(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")

    states = metrics.state_metrics(pairs, "gold_state", "state")
    marks = lambda df, time, tie: metrics.change_points(df, "call_id", time, "state", tie).withColumn("tag", F.lit(None).cast("string"))
    bounds = metrics.boundary_recall(marks(gold_turns, "start_s", "turn_id"), marks(tracked.hops, "t_s", "row_id"), "call_id", (0.5, 1.0, 2.0))
    lifecycle = tracked.events.filter(F.col("event_type").isin("transfer_start", "transfer_end")).select("call_id", F.col("t_s").alias("t"), F.col("event_type").alias("kind"), F.col("outcome").alias("tag"))
    matched = metrics.match_counts(metrics.match_events(gold_events, lifecycle, "call_id", 8.0))
    stable = metrics.stability(tracked.hops, gold_turns).agg(F.sum("changes").alias("changes"), F.sum("gold_changes").alias("gold_changes"), F.sum("excess").alias("excess"))
    calibrated = metrics.calibration(pairs, "confidence", F.col("state") == F.col("gold_state")).agg(F.max("brier").alias("brier"), F.max("ece").alias("ece"))
    latency = metrics.latency(tracked.hops, "latency_ms", cfg.hop_s * 1000)
    parts = [
        long(states, "states", "state", ["precision", "recall", "f1", "support", "accuracy"]), long(bounds, "boundaries", "tolerance_s", ["gold", "found", "recall", "lag_mean", "lag_p95"]),
        long(matched, "transfers", "kind", ["tp", "fp", "fn", "precision", "recall", "f1", "outcome_accuracy"]), long(stable, "stability", None, ["changes", "gold_changes", "excess"]),
        long(calibrated, "calibration", None, ["brier", "ece"]), long(latency, "latency", None, ["mean_ms", "p50_ms", "p95_ms", "max_ms", "over_budget", "rtf"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def training_rows(observed: DataFrame, gold_turns: DataFrame) -> DataFrame:
    """Observations with y, the number of the gold state a quarter of a second before; hops without gold are left out."""
    rows = observed.withColumn("row_id", F.concat_ws("/", "call_id", "hop"))
    y = F.array_position(F.array(*map(F.lit, S.STATES)), F.col("gold_state")).cast("int") - 1
    return metrics.gold_at(rows, gold_turns).withColumn("y", y).filter("y >= 0")


def train_head(observed: DataFrame, gold_turns: DataFrame, calls: DataFrame) -> tuple[models.Head, DataFrame]:
    """A logistic head on the named scalars of three quarters of the calls, its temperature fitted on the others: (head, report of both parts). calls: (call_id, scenario)."""
    parts = models.stratified_holdout(calls, "call_id", "scenario").select("call_id", "is_holdout")
    rows = cut(training_rows(observed, gold_turns).join(parts, "call_id"))
    head = models.Head.fit(rows.filter("NOT is_holdout"), models.SCALARS, "y").with_temperature(rows.filter("is_holdout"), "y")
    # written: filters of the metrics would else be pushed below and repeat the long expressions of the scores
    scored = cut(head.predict(rows).select("is_holdout", "gold_state", "state", "confidence"))
    out = None
    for name, part in (("train", scored.filter("NOT is_holdout")), ("holdout", scored.filter("is_holdout"))):
        one = metrics.state_metrics(part, "gold_state", "state").filter("state = 'all'").select(F.lit(name).alias("part"), "accuracy", F.col("f1").alias("macro_f1"), "support")
        ece = metrics.calibration(part, "confidence", F.col("state") == F.col("gold_state")).agg(F.max("ece").alias("ece")).withColumn("part", F.lit(name))
        one = one.join(ece, "part", "left")
        out = one if out is None else out.unionByName(one)
    return head, out
