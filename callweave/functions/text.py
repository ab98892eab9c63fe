"""Text normalising, tokens, n-grams, phrase scores, hashed embeddings, sub-labels and evidence: built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, everything but letters, digits and apostrophes a blank, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9']+", " "))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9']+)"), F.lit(1))


def ngrams(toks: Column) -> Column:
    """Tokens and a_b pairs of neighbours."""
    pairs = F.when(F.size(toks) > 1, F.zip_with(F.slice(toks, F.lit(1), F.size(toks) - 1), F.slice(toks, F.lit(2), F.size(toks) - 1), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(toks, pairs)


def phrase_score(normal: Column, patterns: Sequence[str]) -> Column:
    """0 if no pattern hits, else 0.55 and 0.2 per pattern, at most 1."""
    hits = sum((normal.rlike(p).cast("int") for p in patterns), F.lit(0))
    return F.when(hits > 0, F.least(F.lit(1.0), 0.55 + 0.2 * hits)).otherwise(F.lit(0.0))


def phrase_hits(normal: Column, patterns: Sequence[str]) -> Column:
    """The patterns that hit, in order."""
    return F.array_compact(F.array(*[F.when(normal.rlike(p), F.lit(p)) for p in patterns]))


def spontaneous_score(normal: Column, toks: Column, human: Sequence[str], markers: Sequence[str]) -> Column:
    """Share of marker words (full at 12 %) and human phrases."""
    ratio = F.when(F.size(toks) > 0, F.size(F.filter(toks, lambda t: t.isin(*markers))) / F.size(toks)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), 0.54 * F.least(ratio / 0.12, F.lit(1.0)) + 0.7 * phrase_score(normal, human))


def hashed_embedding(rows: DataFrame, key: str, grams: str, size: int = 64) -> DataFrame:
    """(key, bucket, value) of the non-zero entries: signed counts of hashed grams, scaled to length one. Every gram is hashed once and combined before the shuffle by key."""
    h = F.conv(F.substring(F.md5("gram"), 1, 9), 16, 10).cast("bigint")
    counts = rows.select(key, F.explode(grams).alias("gram")).withColumn("h", h)
    sums = counts.groupBy(key, F.pmod("h", F.lit(size)).alias("bucket")).agg(F.sum(F.when(F.shiftright("h", 32) % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return sums.withColumn("value", F.col("v") / norm).filter("v <> 0").select(key, "bucket", "value")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, z: acc + z)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sub_label(state: Column, music: Column, speech: Column, silence: Column, tone: Column, spontaneous: Column, text: Column, prompt: Column) -> Column:
    """What kind of its state a hop is."""
    hold = F.when((music >= 0.35) & (speech >= 0.30), "announcement_over_music").when(music >= 0.35, "music").when(silence >= 0.55, "dead_air").otherwise("queue")
    ivr = F.when(normalize(text).rlike(r"\b(press|keypad|pound)\b"), "keypad_menu").when(prompt >= 0.5, "speech_ivr").otherwise("automated_prompt")
    human = F.when(spontaneous >= 0.5, "conversational").when(speech >= 0.3, "speech")
    other = F.when(tone >= 0.15, "ringback_or_tone").when(silence >= 0.6, "silence").otherwise("unclassified")
    return F.when(state == "hold", hold).when(state == "ivr", ivr).when(state == "human", human).when(state == "other", other)


def transcript_gap(gap: Column) -> Column:
    """The mark of a silence before a turn."""
    return F.when(gap > 1.5, F.concat(F.lit("[SILENCE "), F.format_string("%.1f", gap), F.lit("s] "))).otherwise("")
