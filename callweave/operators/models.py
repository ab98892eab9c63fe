"""Evidence models over named scalars: prior weights, logistic fit, temperature, splits by call."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators import ordered

STATES = ("ivr", "human", "hold", "other")
# Prior weights per feature for ivr, human, hold, other.
WEIGHTS: dict[str, tuple[float, float, float, float]] = {
    "ivr_prompt_prob": (3.4, -2.4, -0.8, 0.0), "human_spontaneous_prob": (-1.8, 3.0, -1.4, 0.0), "hold_phrase_prob": (-0.5, -0.9, 1.6, 0.0), "pitch_cv": (-2.0, 3.0, 0.0, 0.0),
    "syllable_mod": (1.8, 1.6, -2.0, -1.2), "slow_mod": (-1.0, -1.0, 1.8, 0.8), "speech_prob": (0.9, 1.2, -1.0, -0.8), "music_prob": (-1.2, -1.8, 3.0, -0.5), "silence_prob": (0.0, -1.2, 0.5, 1.6),
    "tone_prob": (-1.0, -1.0, 0.0, 4.0), "has_text": (0.4, 0.5, -0.8, -0.8), "word_rate": (0.0, 0.3, -0.9, 0.0), "dtmf_recent": (1.1, 0.0, 0.0, 0.0), "agent_recently_spoke": (0.0, 0.55, 0.0, 0.0),
    "spectral_stability": (0.0, 0.0, 0.6, 0.0), "periodicity": (0.0, 0.0, 0.5, 0.0),
}
BIAS = (-0.35, -0.15, -0.45, -0.55)
# Order of the 26 scalars.
SCALARS = "speech_prob music_prob silence_prob tone_prob periodicity spectral_stability pitch_cv_valid pitch_cv syllable_mod slow_mod speaker_change_prob speaker_sim_active speaker_known asr_confidence word_rate has_text ivr_prompt_prob transfer_phrase_prob hold_phrase_prob human_spontaneous_prob agent_recently_spoke time_since_agent_spoke dtmf_recent sip_leg_changed prev_state_is_hold dwell_s_norm".split()
# How a feature reads in a sentence.
PHRASES = {
    "ivr_prompt_prob": "IVR prompt wording", "human_spontaneous_prob": "spontaneous speech markers", "hold_phrase_prob": "hold announcement wording", "transfer_phrase_prob": "transfer announcement", "music_prob": "music bed", "slow_mod": "slow, music-like rhythm",
    "syllable_mod": "syllable-rate speech rhythm", "speech_prob": "speech present", "silence_prob": "little or no energy", "tone_prob": "call-progress tone", "pitch_cv": "pitch variation", "periodicity": "repeating loop", "spectral_stability": "steady spectrum",
    "dtmf_recent": "keypad tone", "word_rate": "speaking rate", "has_text": "words recognised", "agent_recently_spoke": "our agent just spoke", "sip_leg_changed": "carrier reported a new call leg",
}


def clipped_scalars(obs: DataFrame) -> DataFrame:
    """The 26 scalars of an observation, missing ones neutral: rates and times scaled and capped, a pitch of -1 is no evidence."""
    have = set(obs.columns)
    raw = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in have else F.lit(d)
    pitch = raw("pitch_cv", -1.0)
    special = {
        "pitch_cv_valid": (pitch >= 0).cast("double"), "pitch_cv": F.greatest(pitch, F.lit(0.0)), "word_rate": F.least(raw("word_rate", 0.0) / 4, F.lit(1.5)), "time_since_agent_spoke": F.least(raw("time_since_agent_spoke", 30.0) / 30, F.lit(1.0)),
        "dwell_s_norm": F.least(raw("dwell_s", 0.0) / 60, F.lit(1.0)), "has_text": (F.trim(F.coalesce(F.col("text"), F.lit(""))) != "").cast("double") if "text" in have else F.lit(0.0),
    }
    return obs.withColumns({c: special.get(c, raw(c, 0.0)) for c in SCALARS})


def scores(weights: dict[str, tuple[float, ...]] = WEIGHTS, bias: tuple[float, ...] = BIAS) -> list[Column]:
    """Linear score per state; only the named columns are read."""
    return [sum((F.col(f) * w[k] for f, w in weights.items() if w[k]), F.lit(bias[k])) for k in range(len(STATES))]


def softmax(xs: list[Column], temperature: float = 1.0) -> list[Column]:
    """Probabilities of scores, shifted by their maximum."""
    top = F.greatest(*xs)
    es = [F.exp((x - top) / temperature) for x in xs]
    return [e / (sum(es) + 1e-12) for e in es]


def prior_evidence(scalars: DataFrame) -> DataFrame:
    """scalars with p_<state> of the prior model and the state of the largest."""
    named = scalars.withColumns({f"_s{k}": s for k, s in enumerate(scores())})
    ps = softmax([F.col(f"_s{k}") for k in range(4)])
    out = named.withColumns({f"p_{s}": p for s, p in zip(STATES, ps)})
    return out.withColumn("state", F.element_at(F.array(*map(F.lit, STATES)), F.array_position(F.array(*[F.col(f"p_{s}") for s in STATES]), F.greatest(*[F.col(f"p_{s}") for s in STATES])).cast("int"))).drop(*[f"_s{k}" for k in range(4)])


def contributions(state: Column, k: int = 4) -> Column:
    """The k largest signed contributions to a state, largest first (by size, then name)."""
    weight = {f: F.coalesce(*[F.when(state == s, F.lit(w[i])) for i, s in enumerate(STATES)]) for f, w in WEIGHTS.items()}
    parts = F.array(*[F.struct((-F.abs(F.col(f) * w)).alias("size"), F.lit(f).alias("feature"), (F.col(f) * w).alias("value")) for f, w in weight.items()])
    return F.transform(F.slice(F.array_sort(parts), 1, k), lambda x: F.struct(x["feature"].alias("feature"), F.round(x["value"], 6).alias("value")))


def evidence(state: Column, text: Column) -> Column:
    """The strongest positive contributor in words, with the end of the text for wording features."""
    top = F.element_at(F.filter(contributions(state, len(WEIGHTS)), lambda x: x["value"] > 0), 1)["feature"]
    phrase = F.element_at(F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv]), top)
    wording = top.isin("ivr_prompt_prob", "human_spontaneous_prob", "hold_phrase_prob", "transfer_phrase_prob") & (F.trim(text) != "")
    return F.coalesce(F.when(wording, F.concat(phrase, F.lit(": "), F.right(F.trim(text), F.lit(60)))), phrase, F.lit("no single cue"))


def fit_logistic(rows: DataFrame, features: list[str] | str, label: str, l2: float = 3e-3, rounds: int = 100) -> tuple[StandardScaler, LogisticRegressionModel, DataFrame]:
    """Standardised, class-balanced multinomial logistic regression: (scaler, model, scored rows)."""
    vec = rows.withColumn("_v", array_to_vector(F.col(features).cast("array<double>"))) if isinstance(features, str) else VectorAssembler(inputCols=features, outputCol="_v").transform(rows)
    total, counts = rows.count(), {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    weight = F.lit(1.0)
    for v, n in counts.items():
        weight = F.when(F.col(label) == v, total / (len(counts) * n)).otherwise(weight)
    scaler = StandardScaler(inputCol="_v", outputCol="_x", withMean=True, withStd=True).fit(vec)
    ready = scaler.transform(vec).withColumn("_w", weight).withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", regParam=l2, standardization=False, maxIter=rounds).fit(ready)
    return scaler, model, model.transform(ready)


@dataclass(frozen=True)
class Head:
    """A fitted logistic head as plain numbers, so that it is saved as JSON and scores with built-in expressions."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    temperature: float = 1.0

    @classmethod
    def fit(cls, rows: DataFrame, features: Sequence[str], label: str, l2: float = 3e-3, rounds: int = 100) -> Head:
        scaler, model, _ = fit_logistic(rows, list(features), label, l2, rounds)
        m, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        full = lambda a: [*a.tolist(), *[[0.0] * len(features)] * (len(STATES) - len(a))]
        low = [*b.tolist(), *[-50.0] * (len(STATES) - len(b))]  # a state that the training rows lack is never chosen
        std = [float(x) or 1.0 for x in scaler.std.toArray()]
        return cls(tuple(features), tuple(map(float, scaler.mean.toArray())), tuple(std), tuple(map(tuple, full(m))), tuple(low))

    def logits(self) -> list[Column]:
        x = [(F.col(f) - m) / s for f, m, s in zip(self.features, self.mean, self.std)]
        return [sum((c * w for c, w in zip(x, ws)), F.lit(b)) for ws, b in zip(self.weights, self.bias)]

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with p_<state>, the state of the largest and its confidence."""
        named = rows.withColumns({f"_s{k}": s for k, s in enumerate(self.logits())})
        out = named.withColumns({f"p_{s}": p for s, p in zip(STATES, softmax([F.col(f"_s{k}") for k in range(len(STATES))], self.temperature))})
        top = F.greatest(*[F.col(f"p_{s}") for s in STATES])
        best = F.array_position(F.array(*[F.col(f"p_{s}") for s in STATES]), top).cast("int")
        return out.withColumns({"confidence": top, "state": F.element_at(F.array(*map(F.lit, STATES)), best)}).drop(*[f"_s{k}" for k in range(len(STATES))])

    def with_temperature(self, rows: DataFrame, label: str) -> Head:
        """The temperature of the grid with the least negative log likelihood of rows; the lowest of equals, 1 without rows."""
        scored = rows.select(label, *[s.alias(f"s{k}") for k, s in enumerate(self.logits())])
        best = temperature_grid(scored, [f"s{k}" for k in range(len(STATES))], label).agg(F.min_by("temperature", F.struct("nll", "temperature"))).first()[0]
        return replace(self, temperature=best if best is not None else 1.0)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self)))

    @classmethod
    def load(cls, path: str) -> Head:
        return cls(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in json.loads(Path(path).read_text()).items()})


def temperature_grid(rows: DataFrame, logits: list[str], label: str, low: float = 0.5, high: float = 4.0, step: float = 0.05) -> DataFrame:
    """(temperature, nll) of every temperature of a fixed grid; sums are combined before the shuffle, so only the grid is shuffled."""
    temps = [round(low + i * step, 2) for i in range(round((high - low) / step) + 1)]
    grid = rows.select(*logits, label, F.explode(F.array(*map(F.lit, temps))).alias("temperature"))
    t, top = F.col("temperature"), F.greatest(*logits)
    own = F.coalesce(*[F.when(F.col(label) == i, F.col(c)) for i, c in enumerate(logits)])
    p = F.exp((own - top) / t) / (sum((F.exp((F.col(c) - top) / t) for c in logits), F.lit(0.0)) + 1e-12)
    return grid.groupBy("temperature").agg(F.round(F.avg(-F.log(p + 1e-12)), 6).alias("nll"))


def stratified_holdout(calls: DataFrame, call: str, stratum: str, share: float = 0.34, seed: str = "7") -> DataFrame:
    """calls with is_holdout: per stratum max(1, round(share * n)) calls with the smallest hashes, none where there is one call only."""
    # the limit is the hash of rank k - 1: found by a histogram, no stratum is brought into one task
    drawn = calls.withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(call).cast("string"))), 1, 15), 16, 10).cast("bigint"))
    want = F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("int"))
    limits = ordered.ranked_values(drawn, [stratum], "_h", {"_limit": want - 1}).filter("_n > 1").select(F.col(stratum).alias("_s"), "_limit")
    got = drawn.join(limits, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    return got.withColumn("is_holdout", F.coalesce(F.col("_h") <= F.col("_limit"), F.lit(False))).drop("_h", "_s", "_limit")


def random_projection(dim: int, width: int, seed: int) -> list[list[float]]:
    """A Gaussian matrix of deviation 1/sqrt(width) from a seed."""
    import numpy as np

    return np.random.default_rng(seed).normal(0, 1 / math.sqrt(width), (dim, width)).tolist()


def project(vector: Column, matrix: list[list[float]], squash: float = 1.0) -> Column:
    """tanh(vector @ matrix / squash) as built-in array expressions; zeros where the length differs."""
    width = len(matrix[0])
    cols = [F.aggregate(F.zip_with(vector, F.array(*[F.lit(row[j]) for row in matrix]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x) for j in range(width)]
    return F.when(F.size(vector) == len(matrix), F.array(*[F.tanh(c / squash) for c in cols])).otherwise(F.array(*[F.lit(0.0)] * width))
