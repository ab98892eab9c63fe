"""Acoustic observations of hops from WAV bytes: one Arrow pass per call, trailing windows only (nothing ahead is read)."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from callweave.functions import signal
from callweave.sources.wav import decode

FEATURES = ("speech_prob", "music_prob", "silence_prob", "tone_prob", "periodicity", "spectral_stability", "pitch_cv", "syllable_mod", "slow_mod")
#: Share of a block's energy that a key's two tones must hold.
IN_BAND = 0.15
SCHEMA = "call_id string, t_s double, " + ", ".join(f"{f} double" for f in FEATURES) + ", agent_speaking boolean, keys string, voice array<double>, audio array<double>"


def window_features(calls: DataFrame, hop_s: float = 0.5, short_s: float = 2.5, long_s: float = 6.0, voice_s: float = 3.0, rate: int = 8000, timed: bool = False) -> DataFrame:
    """(call_id, t_s, scores, agent_speaking, keys, voice and audio embeddings) every hop_s, first after one frame of 20 ms; with timed also acoustic_ms, what the hop's measures took. calls: (call_id, wav). Unreadable files raise."""
    timing = ["acoustic_ms"] if timed else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for call, data in zip(batch["call_id"], batch["wav"]):
                x, sr = decode(bytes(data))
                agent = signal.agent_channel(x, sr)
                remote = signal.resample(x[:, 0 if agent < 0 else (agent + 1) % x.shape[1]], sr, rate)
                own = signal.resample(x[:, agent], sr, rate) if agent >= 0 else remote * 0
                rows, k = [], 0
                while (t := 0.02 + k * hop_s) * rate <= len(remote):
                    end, began = int(round(t * rate)), time.perf_counter()
                    short, long = remote[max(0, end - int(short_s * rate)) : end], remote[max(0, end - int(long_s * rate)) : end]
                    second, said = remote[max(0, end - rate) : end], own[max(0, end - rate) : end]
                    scores = signal.observe(short, long, rate)
                    rows.append((call, t, *(float(scores[f]) for f in FEATURES), bool(len(said) and (said.astype(float) ** 2).mean() ** 0.5 > 0.01), signal.dtmf(second, rate, share=IN_BAND), signal.voice_embedding(remote[max(0, end - int(voice_s * rate)) : end], rate).tolist(), signal.log_mel_embedding(long, rate).tolist(), *([round((time.perf_counter() - began) * 1000, 3)] if timed else [])))
                    k += 1
                yield pd.DataFrame(rows, columns=["call_id", "t_s", *FEATURES, "agent_speaking", "keys", "voice", "audio", *timing])

    return calls.select("call_id", "wav").mapInPandas(run, SCHEMA + "".join(f", {c} double" for c in timing))
