"""Queries pN_... of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import annotators, bpe, garbled, nearest, packing, pii, runs, splits
from callweave.session import cut, table

CAPACITY = 2_048


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.leaking_chunks(table(spark, d, "chunks"), table(spark, d, "clips"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.recording_splits(table(spark, d, "chunks"), table(spark, d, "clips"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for p1_splits: every recording with its chunks, in one split."""
    return p1_splits(spark, d).groupBy("recording").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("split").alias("splits"))


def p1_components(spark: SparkSession, d: str) -> DataFrame:
    """Chunks related over any of source_call, source_file and audio_path, by contraction: the smallest chunk of each component."""
    named = splits.recordings(table(spark, d, "chunks"))
    got = splits.components(named, "chunk_id", ["source", "file", "audio"])
    least = got.groupBy("component").agg(F.min("chunk_id").alias("first_chunk"))
    return got.join(least, "component").select("chunk_id", "first_chunk")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return annotators.consensus(table(spark, d, "labeler_votes")).items.select("item_id", "label")


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    got = annotators.consensus(table(spark, d, "labeler_votes")).items
    return got.select("item_id", "label", F.round("posterior", 6).alias("posterior"), F.round("agreement", 6).alias("agreement"), "n_votes")


def p2_labelers(spark: SparkSession, d: str) -> DataFrame:
    got = annotators.consensus(table(spark, d, "labeler_votes")).labelers
    return got.select("labeler", "community", F.round("reliability", 6).alias("reliability"), "n_votes")


LEG_KINDS = ("siplegchanged", "participantchanged")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    kind = F.regexp_replace(F.lower("kind"), r"[^\p{L}\p{N}]+", "")
    legs = table(spark, d, "telephony").filter(kind.isin(*LEG_KINDS)).select("tel_id", "call_id", "t_s")
    got = nearest.nearest_in_time(table(spark, d, "call_events").select("event_id", "call_id", "t_s"), legs, query_id="event_id", candidate_id="tel_id", entity="call_id", time="t_s", tolerance_s=3.0)
    return got.select(F.col("query_id").alias("event_id"), F.col("match_id").alias("tel_id"))


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "timeline").select("row_id", "call_id", "t_s", "state"), entity="call_id", time="t_s", state="state", row_id="row_id", most_gap_s=5.0, least_events=least)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 2).select(F.col("entity").alias("call_id"), F.col("first_row_id"), F.col("events").alias("hop_count"), F.round((F.col("last_us") - F.col("first_us")) / 1_000, 0).cast("bigint").alias("duration_ms"))


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 1).select(F.col("entity").alias("call_id"), "state", F.col("first_row_id"), F.col("events").alias("hop_count"), F.round((F.col("last_us") - F.col("first_us")) / 1_000, 0).cast("bigint").alias("duration_ms"))


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, pii.SemiMarkov]:
    turns, obs, segments = (table(spark, d, x) for x in ("gold_turns", "semantic_obs", "labeler_segments"))
    return pii.text_rows(turns, obs, segments), pii.fit_model([turns.select("text"), obs.select("text"), segments.select("evidence")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(*_texts(spark, d))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_rows(*_texts(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    # sizes are used twice (to count and to pack), so the texts are encoded once and the sizes written
    return packing.pack(cut(bpe.count_tokens(table(spark, d, "documents"))), "doc_id", "n_tokens", CAPACITY)


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("container", F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("used")).withColumn("unused", F.lit(CAPACITY) - F.col("used"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_documents(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore_encoding(table(spark, d, "documents")).filter("garbled").select("doc_id", "restorable", "chains", "restored")


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_groups, p1_components, p2_found, p2_items, p2_labelers, p4_found, p5_found, p5_runs, p6_found, p6_redacted, p8_ids, p9_pack, p9_containers, p10_found, p10_restored)}

_NAME_SQL = r"""nullif(regexp_replace(regexp_replace(trim(regexp_replace(lower(trim({0})), '^.*[/\\]', '')), '(?:\.(?:beeped|wav|mp3|mp4|m4a|flac|ogg|opus|aac)|\s*\(\d+\)|[\s_.-]+v\d+|[\s_.-]+(?:copy|export)(?:[\s_.-]*\d+)?)+$', ''), '[^\p{{L}}\p{{N}}]+', '', 'g'), '')"""
_RUNS_SQL = r"""
WITH clean AS (
  SELECT call_id, regexp_replace(lower(state), '[^\p{L}\p{N}]+', '', 'g') AS state, CAST(round(t_s * 1000000) AS BIGINT) AS us, row_id FROM timeline
  WHERE call_id IS NOT NULL AND t_s IS NOT NULL AND NOT isnan(t_s) AND state IS NOT NULL),
hops AS (SELECT call_id, us, min(state) AS state, min(row_id) AS row_id FROM clean WHERE state <> '' GROUP BY call_id, us),
marked AS (SELECT *, CASE WHEN lag(state) OVER w = state AND us - lag(us) OVER w <= 5000000 THEN 0 ELSE 1 END AS starts FROM hops WINDOW w AS (PARTITION BY call_id ORDER BY us)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY call_id ORDER BY us) AS run FROM marked)
"""

SQL = {
    "p1_found": f"""
WITH named AS (SELECT chunk_id, coalesce({_NAME_SQL.format('source_call')}, {_NAME_SQL.format('source_file')}, 'chunk ' || chunk_id) AS recording FROM chunks),
tags AS (SELECT call_id, regexp_replace(lower(split_tag), '[^a-z0-9]+', '', 'g') AS t FROM clips),
canon AS (SELECT call_id, CASE WHEN t LIKE 'tr%' THEN 'train' WHEN t LIKE 'val%' OR t LIKE 'dev%' THEN 'validation' WHEN t IN ('test', 'tst') THEN 'test' ELSE t END AS tag FROM tags WHERE t <> ''),
leaking AS (SELECT recording FROM named JOIN canon ON chunk_id = call_id GROUP BY recording HAVING count(DISTINCT tag) >= 2)
SELECT chunk_id FROM named WHERE recording IN (SELECT recording FROM leaking)""",
    "p1_groups": f"""
SELECT recording, count(*) AS chunks, CAST(1 AS BIGINT) AS splits FROM (SELECT coalesce('k0:' || coalesce({_NAME_SQL.format('source_call')}, {_NAME_SQL.format('source_file')}), 'r:' || chunk_id) AS recording FROM chunks) GROUP BY 1""",
    "p1_components": f"""
WITH RECURSIVE named AS (SELECT chunk_id, {_NAME_SQL.format('source_call')} AS s, {_NAME_SQL.format('source_file')} AS f, {_NAME_SQL.format('audio_path')} AS a FROM chunks),
keys AS (SELECT chunk_id, 's' || s AS k FROM named WHERE s IS NOT NULL UNION SELECT chunk_id, 'f' || f FROM named WHERE f IS NOT NULL UNION SELECT chunk_id, 'a' || a FROM named WHERE a IS NOT NULL),
near AS (SELECT DISTINCT x.chunk_id AS u, y.chunk_id AS v FROM keys x JOIN keys y USING (k)),
reach AS (SELECT chunk_id AS u, chunk_id AS v FROM named UNION SELECT reach.u, near.v FROM reach JOIN near ON reach.v = near.u)
SELECT u AS chunk_id, min(v) AS first_chunk FROM reach GROUP BY 1""",
    "p4_found": r"""
WITH legs AS (
  SELECT lower(trim(call_id)) AS c, CAST(round(t_s * 1000000) AS BIGINT) AS us, min(tel_id) AS tel_id FROM telephony
  WHERE regexp_replace(lower(kind), '[^\p{L}\p{N}]+', '', 'g') IN ('siplegchanged', 'participantchanged') AND t_s IS NOT NULL AND NOT isnan(t_s) AND call_id IS NOT NULL GROUP BY 1, 2),
ev AS (SELECT event_id, lower(trim(call_id)) AS c, CAST(round(t_s * 1000000) AS BIGINT) AS us FROM call_events WHERE t_s IS NOT NULL AND NOT isnan(t_s) AND call_id IS NOT NULL),
near AS (SELECT event_id, tel_id, row_number() OVER (PARTITION BY event_id ORDER BY abs(ev.us - legs.us), tel_id) AS k FROM ev JOIN legs ON ev.c = legs.c AND abs(ev.us - legs.us) <= 3000000)
SELECT event_id, tel_id FROM near WHERE k = 1""",
    "p5_found": _RUNS_SQL + "SELECT call_id, arg_min(row_id, us) AS first_row_id, count(*) AS hop_count, CAST(round((max(us) - min(us)) / 1000.0) AS BIGINT) AS duration_ms FROM numbered GROUP BY call_id, run HAVING count(*) >= 2",
    "p5_runs": _RUNS_SQL + "SELECT call_id, min(state) AS state, arg_min(row_id, us) AS first_row_id, count(*) AS hop_count, CAST(round((max(us) - min(us)) / 1000.0) AS BIGINT) AS duration_ms FROM numbered GROUP BY call_id, run",
}
