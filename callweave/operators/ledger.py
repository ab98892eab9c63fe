"""Cost and run ledgers, result caches, review overrides and published clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.numbers import rounded

# US dollars per million tokens (labeler, text in, text out, audio in, audio out).
PRICES = [("gemini", 1.50, 7.50, 1.50, 7.50), ("gpt_audio", 2.50, 10.0, 32.0, 64.0), ("asr_llm", 0.25, 2.00, 0.25, 2.00)]


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "labeler string, text_in double, text_out double, audio_in double, audio_out double")


def cost_usd(prompt: Column, completion: Column, audio_prompt: Column | None = None, audio_completion: Column | None = None) -> Column:
    """Cost of one result; audio tokens are part of the totals, the rest is text and never negative. Rows of an unknown labeler cost NULL."""
    zero = F.lit(0).cast("double")
    ai, ao = F.coalesce(audio_prompt, zero) if audio_prompt is not None else zero, F.coalesce(audio_completion, zero) if audio_completion is not None else zero
    text_in, text_out = F.greatest(zero, F.coalesce(prompt, zero) - ai), F.greatest(zero, F.coalesce(completion, zero) - ao)
    return (text_in * F.col("text_in") + ai * F.col("audio_in") + text_out * F.col("text_out") + ao * F.col("audio_out")) / 1e6


def token_total(*shapes: Column) -> Column:
    """The first of several places of a count that is not zero; zero counts as missing."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in shapes])


def usage_tokens(usage_json: Column) -> tuple[Column, Column]:
    """(prompt, completion) tokens of a usage record in any of the known shapes."""
    get = lambda *paths: token_total(*[F.get_json_object(usage_json, p).cast("bigint") for p in paths])
    return get("$.prompt_tokens", "$.prompt_token_count", "$.input_tokens"), get("$.completion_tokens", "$.candidates_token_count", "$.output_tokens")


def cache_plan(requested: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """requested with cached: true where an ok result exists; errors and missing results are run (again)."""
    ok = results.filter("status = 'ok'").select(*keys).distinct().withColumn("_ok", F.lit(True))
    return requested.join(ok, keys, "left").withColumn("cached", F.coalesce("_ok", F.lit(False))).drop("_ok")


def chunk_costs(rows: DataFrame, chunk: str) -> DataFrame:
    """Per chunk: known cost, whether it is complete (errors don't break completeness, unknown costs of finished rows do), cost per minute."""
    return rows.groupBy(chunk).agg(
        rounded(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
        F.bool_and(F.col("cost_usd").isNotNull() | (F.col("status") == "error")).alias("cost_complete"),
        F.sum("latency_s").alias("_latency"), F.max("duration_s").alias("_dur"), F.count_if(F.col("status") == "error").alias("errors"),
    ).select(chunk, "cost_usd", "cost_complete", "errors", rounded(F.col("_latency") / F.col("_dur"), 6).alias("rtf"), rounded(F.col("cost_usd") / (F.col("_dur") / 60), 6).alias("cost_per_min"))


def run_ledger(rows: DataFrame, chunk: str, labeler: str) -> DataFrame:
    """Totals per chunk, per labeler and altogether in one pass over the rows."""
    return rows.groupingSets([[F.col(chunk)], [F.col(labeler)], []], F.col(chunk), F.col(labeler)).agg(
        F.grouping(chunk).alias("all_chunks"), F.grouping(labeler).alias("all_labelers"), F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.sum("tokens").alias("tokens")
    )


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key: what a review wrote last holds, blanks included."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def published(gold: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """gold with the review's label where there is one: final_label, reviewed."""
    r = reviewed.select(*keys, F.col("final_label").alias("_final"))
    return gold.join(r, keys, "left").withColumn("final_label", F.coalesce("_final", "label")).withColumn("reviewed", F.col("_final").isNotNull()).drop("_final")
