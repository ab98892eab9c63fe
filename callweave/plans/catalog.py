"""Queries over the domain tables, one per operator, with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import lexicon, text
from callweave.functions.numbers import rounded
from callweave.operators import consensus, intervals, ledger, metrics, models, ordered, sequence, timeseries
from callweave.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: str, n: int = 6):
    return rounded(c, n).alias(c)


# ---- tables as the operators want them ---------------------------------------------------------------------------------


def hops(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.clean_hops(table(spark, d, "timeline"))


HOPS = r"""hops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, t_s ORDER BY row_id) AS k_ FROM (
  SELECT row_id, call_id, t_s, nullif(regexp_replace(lower(state), '[^a-z]', '', 'g'), '') AS state, confidence, speaker_id, transfer_in_progress, latency_ms, sub_label FROM timeline)
  WHERE call_id IS NOT NULL AND t_s IS NOT NULL AND state IS NOT NULL) WHERE k_ = 1)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Labeler segments as intervals of their chunk, sent once, cut to it."""
    s = table(spark, d, "labeler_segments").select("seg_id", "call_id", "labeler", "seq", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "label", "confidence", "human_id")
    once = intervals.first_copies(intervals.usable(s), ["call_id", "labeler", "seq"], "seg_id")
    dur = calls(spark, d)
    return once.join(dur, "call_id").filter("start < duration_s").withColumn("end", F.least("end", "duration_s"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("duration_s > 0").select(F.col("chunk_id").alias("call_id"), "duration_s")


RAW_SEG = """once AS (SELECT * FROM (SELECT seg_id, call_id, labeler, seq, seg_start AS s, seg_end AS e, label, confidence, human_id, row_number() OVER (PARTITION BY call_id, labeler, seq ORDER BY seg_id) AS k_
  FROM labeler_segments WHERE seg_end > seg_start AND NOT isnan(seg_start) AND NOT isnan(seg_end)) WHERE k_ = 1),
calls AS (SELECT chunk_id AS call_id, duration_s AS dur FROM chunks WHERE duration_s > 0)"""
SEG = RAW_SEG + """,
seg AS (SELECT seg_id, call_id, labeler, seq, s, least(e, dur) AS e, label, confidence, human_id, dur FROM once JOIN calls USING (call_id) WHERE s < dur)"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_turns").filter("end_s > start_s AND call_id IS NOT NULL")


# ---- intervals and chunks ----------------------------------------------------------------------------------------------


@query("""SELECT chunk_id, i AS chunk_index, i * 60.0 AS start_s, CASE WHEN i = kept - 1 THEN duration_s ELSE (i + 1) * 60.0 END AS end_s FROM (
  SELECT chunk_id, duration_s, CASE WHEN n > 1 AND duration_s - (n - 1) * 60.0 < 15 THEN n - 1 ELSE n END AS kept FROM (SELECT chunk_id, duration_s, CAST(ceil(duration_s / 60.0) AS INTEGER) AS n FROM chunks WHERE duration_s > 0)) x, unnest(range(0, kept)) t(i)""")
def chunk_plan(spark, d):
    return intervals.plan_chunks(table(spark, d, "chunks"), "chunk_id", "duration_s", 60.0, 15.0)


@query("""SELECT left(chunk_id, 8) || '_c' || lpad(CAST(i AS VARCHAR), 2, '0') AS chunk_id, chunk_id AS call_id, i AS chunk_index, round(i * 60.0, 3) AS offset_s, round(CASE WHEN i = kept - 1 THEN duration_s ELSE (i + 1) * 60.0 END - i * 60.0, 3) AS duration_s FROM (
  SELECT chunk_id, duration_s, CASE WHEN n > 1 AND duration_s - (n - 1) * 60.0 < 15 THEN n - 1 ELSE n END AS kept FROM (SELECT chunk_id, duration_s, CAST(ceil(duration_s / 60.0) AS INTEGER) AS n FROM chunks WHERE duration_s > 0)) x, unnest(range(0, kept)) t(i)""")
def chunk_metadata(spark, d):
    spans = chunk_plan(spark, d).withColumnRenamed("chunk_id", "call_id")
    return intervals.chunk_metadata(spans, "call_id")


@query("SELECT source_call, chunk_id, chunk_index, offset_s FROM (SELECT *, row_number() OVER (PARTITION BY source_call ORDER BY chunk_index, chunk_id) AS k FROM chunks WHERE source_call IS NOT NULL) WHERE k = 1")
def first_chunks(spark, d):
    return intervals.first_chunk_per_call(table(spark, d, "chunks").filter("source_call IS NOT NULL"), "source_call").select("source_call", "chunk_id", "chunk_index", "offset_s")


@query("SELECT DISTINCT chunk_id AS call_id FROM chunks WHERE chunk_id NOT IN (SELECT call_id FROM clips)")
def missing_ids(spark, d):
    return intervals.missing_ids(table(spark, d, "chunks").select(F.col("chunk_id").alias("call_id")), table(spark, d, "clips"), "call_id")


@query("WITH " + RAW_SEG + """ SELECT call_id, labeler, n, max_end, dur, CASE WHEN n >= 3 AND dur > 0 AND max_end > 0 AND max_end < 0.25 * dur AND 60 * max_end <= 1.15 * dur THEN 60.0 ELSE 1.0 END AS scale
  FROM (SELECT call_id, labeler, count(*) AS n, max(e) AS max_end, max(dur) AS dur FROM once JOIN calls USING (call_id) GROUP BY 1, 2)""")
def unit_scale(spark, d):
    return intervals.unit_scale(_raw_segments(spark, d), ["call_id", "labeler"])


def _raw_segments(spark, d):
    s = table(spark, d, "labeler_segments").select("seg_id", "call_id", "labeler", "seq", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "label")
    return intervals.first_copies(intervals.usable(s), ["call_id", "labeler", "seq"], "seg_id").join(calls(spark, d), "call_id")


@query("WITH " + RAW_SEG + """, sc AS (SELECT call_id, labeler, CASE WHEN count(*) >= 3 AND max(e) > 0 AND max(e) < 0.25 * max(dur) AND 60 * max(e) <= 1.15 * max(dur) THEN 60.0 ELSE 1.0 END AS scale FROM once JOIN calls USING (call_id) GROUP BY 1, 2),
x AS (SELECT call_id, labeler, s AS s0, e AS e0, dur, scale, s * scale AS s, e * scale AS e FROM once JOIN calls USING (call_id) JOIN sc USING (call_id, labeler)),
g AS (SELECT call_id, labeler, max(scale) AS unit_scale, count(*) FILTER (s >= dur) AS dropped, count(*) FILTER (s < dur AND e > dur) AS truncated, floor((max(e0)) * 1000.0 + 0.5) / 1000.0 AS span_before_s, floor((coalesce(max(least(e, dur)) FILTER (s < dur AND least(e, dur) > s), 0)) * 1000.0 + 0.5) / 1000.0 AS span_after_s,
  CAST(sum(CAST(floor((e0 - s0) * 1000.0 + 0.5) AS BIGINT)) AS BIGINT) / 1000.0 AS coverage_before_s, coalesce(CAST(sum(CAST(floor((least(e, dur) - s) * 1000.0 + 0.5) AS BIGINT)) FILTER (s < dur AND least(e, dur) > s) AS BIGINT), 0) / 1000.0 AS c, max(dur) AS dur FROM x GROUP BY 1, 2)
SELECT call_id, labeler, unit_scale, dropped, truncated, span_before_s, span_after_s, coverage_before_s, c AS coverage_after_s, floor((c / dur) * 1000.0 + 0.5) / 1000.0 AS coverage_fraction,
  concat_ws('; ', CASE WHEN unit_scale <> 1 THEN 'times were minutes' END, CASE WHEN dropped > 0 THEN dropped || ' dropped' END, CASE WHEN truncated > 0 THEN truncated || ' truncated' END) AS note FROM g""")
def repair_report(spark, d):
    return intervals.repair_report(_raw_segments(spark, d), ["call_id", "labeler"])


@query("WITH " + SEG + ", " + HOPS + """ SELECT row_id, labeler, arg_min(label, seq) AS label FROM (SELECT h.row_id, seg.labeler, seg.label, seg.seq FROM hops h JOIN seg ON h.call_id = seg.call_id AND h.t_s >= seg.s AND h.t_s < seg.e WHERE seg.label IS NOT NULL) GROUP BY 1, 2""")
def interval_lookup(spark, d):
    at = intervals.interval_join(hops(spark, d).select("call_id", "row_id", "t_s"), segments(spark, d).filter("label IS NOT NULL").select("call_id", "labeler", "seq", "label", "start", "end"), ["call_id"], "t_s")
    return at.groupBy("row_id", "labeler").agg(F.min_by("label", "seq").alias("label"))


_TIE = "CASE labeler WHEN 'asr_llm' THEN 1 WHEN 'gpt_audio' THEN 2 WHEN 'gemini' THEN 3 ELSE 1073741824 END"
_GRID = "WITH " + SEG + f""", cells AS (SELECT seg.call_id, labeler, f AS frame, arg_max(label, seq) AS label FROM seg, unnest(range(CAST(greatest(0, floor(s / 0.25)) AS BIGINT), CAST(least(ceil(dur / 0.25), ceil(e / 0.25)) AS BIGINT))) t(f) GROUP BY 1, 2, 3),
n AS (SELECT call_id, frame, label, count(*) AS n, min({_TIE}) AS rank FROM cells WHERE label IS NOT NULL GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY call_id, frame ORDER BY n DESC, rank, label) AS k, sum(n) OVER (PARTITION BY call_id, frame) AS voters FROM n),
spine AS (SELECT call_id, f AS frame FROM calls, unnest(range(0, CAST(ceil(dur / 0.25) AS BIGINT))) t(f)),
voted AS (SELECT call_id, frame, coalesce(label, 'unknown') AS label, coalesce(n / voters, 0) AS agreement, CAST(coalesce(voters, 0) AS BIGINT) AS n_voters FROM spine LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (call_id, frame))
"""


@query(_GRID + "SELECT call_id, frame, label, n_voters, round(agreement, 6) AS agreement FROM voted")
def grid_vote(spark, d):
    got = consensus.grid_vote(segments(spark, d), calls(spark, d))
    return got.select("call_id", F.col("frame").cast("bigint").alias("frame"), "label", F.col("n_voters").cast("bigint").alias("n_voters"), F.round("agreement", 6).alias("agreement"))


@query(_GRID + """, m AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS st FROM voted WINDOW w AS (PARTITION BY call_id ORDER BY frame)), r AS (SELECT *, sum(st) OVER (PARTITION BY call_id ORDER BY frame) AS run FROM m)
SELECT call_id, min(label) AS label, min(frame) * 0.25 AS start, (max(frame) + 1) * 0.25 AS "end", floor(avg(agreement) * 100.0 + 0.5) / 100.0 AS agreement, min(n_voters) AS min_voters FROM r GROUP BY call_id, run""")
def grid_segments(spark, d):
    return consensus.collapse_grid(consensus.grid_vote(segments(spark, d), calls(spark, d))).select("call_id", "label", "start", "end", "agreement", F.col("min_voters").cast("bigint").alias("min_voters"))


_CUTS = "WITH " + SEG + """, b AS (SELECT call_id, s AS b FROM seg WHERE s BETWEEN 0 AND dur UNION SELECT call_id, e FROM seg WHERE e BETWEEN 0 AND dur UNION SELECT call_id, 0.0 FROM calls UNION SELECT call_id, dur FROM calls),
bl AS (SELECT call_id, list_sort(list(b)) AS bs FROM b GROUP BY 1),
kept AS (SELECT call_id, dur, list_reduce(bs, lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] >= 0.05 THEN acc || x ELSE acc END, CAST([] AS DOUBLE[])) AS k FROM (SELECT call_id, list_transform(bs, lambda v: [v]) AS bs FROM bl) JOIN calls USING (call_id)),
cuts AS (SELECT call_id, CASE WHEN k[-1] < dur THEN k[:-2] || [dur] ELSE k END AS cuts FROM kept)
"""


@query(_CUTS + "SELECT call_id, i AS k, cuts[i + 1] AS cut FROM cuts, unnest(range(0, len(cuts))) t(i)")
def common_refinement_cuts(spark, d):
    return consensus.refinement_cuts(segments(spark, d), calls(spark, d)).select("call_id", F.col("k").cast("bigint").alias("k"), "cut")


_VOTE = _CUTS.rstrip() + f""", spans AS (SELECT call_id, i AS k, cuts[i + 1] AS s, cuts[i + 2] AS e, (cuts[i + 1] + cuts[i + 2]) / 2 AS mid FROM cuts, unnest(range(0, len(cuts) - 1)) t(i)),
votes AS (SELECT call_id, k, labeler, label, human_id, confidence FROM (SELECT spans.call_id, spans.k, seg.labeler, seg.label, seg.human_id, seg.confidence, row_number() OVER (PARTITION BY spans.call_id, spans.k, seg.labeler ORDER BY seg.seq) AS z FROM spans JOIN seg ON spans.call_id = seg.call_id AND spans.mid >= seg.s AND spans.mid < seg.e) WHERE z = 1),
n AS (SELECT call_id, k, label, count(*) AS n, min({_TIE}) AS rank FROM votes WHERE label IS NOT NULL GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY call_id, k ORDER BY n DESC, rank, label) AS z, sum(n) OVER (PARTITION BY call_id, k) AS voters, count(*) OVER (PARTITION BY call_id, k, n) > 1 AS tie FROM n),
voted AS (SELECT call_id, k, s, e, coalesce(label, 'unknown') AS label, coalesce(n / voters, 0) AS agreement, CAST(coalesce(voters, 0) AS BIGINT) AS n_voters, coalesce(tie, false) AS tie FROM spans LEFT JOIN (SELECT * FROM best WHERE z = 1) USING (call_id, k))
"""


@query(_VOTE.rstrip() + """, maps AS (SELECT call_id, k, string_agg(labeler || '=' || label, ';' ORDER BY labeler) FILTER (label IS NOT NULL) AS votes, string_agg(labeler || '=' || human_id, ';' ORDER BY labeler) FILTER (human_id IS NOT NULL) AS speakers, CAST(count(confidence) AS BIGINT) AS n_confidences, max(round(confidence, 2)) AS surest FROM votes GROUP BY 1, 2)
SELECT call_id, k, s AS start, e AS "end", label, floor((agreement) * 1000000.0 + 0.5) / 1000000.0 AS agreement, n_voters, tie, coalesce(maps.votes, '') AS votes, coalesce(maps.speakers, '') AS speakers, coalesce(n_confidences, 0) AS n_confidences, surest FROM voted LEFT JOIN maps USING (call_id, k)""")
def ensemble_vote_intervals(spark, d):
    got = consensus.vote_intervals(segments(spark, d), calls(spark, d))
    # maps are shown as text, which every engine compares alike
    listed = lambda c: F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"])), ";"), F.lit("")).alias(c)
    return got.select("call_id", F.col("k").cast("bigint").alias("k"), "start", "end", "label", _r("agreement"), F.col("n_voters").cast("bigint").alias("n_voters"), "tie", listed("votes"), listed("speakers"), F.coalesce(F.size("confidences"), F.lit(0)).cast("bigint").alias("n_confidences"), F.array_max(F.map_values("confidences")).alias("surest"))


@query(_VOTE + "SELECT call_id, labeler, count(DISTINCT human_id) AS n_ids FROM votes WHERE human_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT human_id) > 1")
def informative_labelers(spark, d):
    return consensus.informative_labelers(consensus.refined_votes(segments(spark, d), calls(spark, d))[1])


def _named(spark, d):
    # the votes are used three times (labels, informative labelers, speakers): evaluated once and written
    spans, votes = consensus.refined_votes(segments(spark, d), calls(spark, d))
    spans, votes = cut(spans), cut(votes)
    return consensus.assign_speakers(consensus.tally(spans, votes), votes)


@query()
def assign_speakers(spark, d):
    return _named(spark, d).select("call_id", "k", "label", "human_id", "speaker_change_votes")


@query()
def gold_segments(spark, d):
    return consensus.merge_intervals(_named(spark, d)).drop("speakers")


_MERGED = _VOTE.rstrip() + f""", who AS (SELECT call_id, k, first(human_id ORDER BY {_TIE}, labeler) AS human_id FROM votes WHERE human_id IS NOT NULL GROUP BY 1, 2), spoken AS (SELECT voted.*, human_id FROM voted LEFT JOIN who USING (call_id, k)), m AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(human_id) OVER w IS NOT DISTINCT FROM human_id THEN 0 ELSE 1 END AS st FROM spoken WINDOW w AS (PARTITION BY call_id ORDER BY k)), r AS (SELECT *, sum(st) OVER (PARTITION BY call_id ORDER BY k) AS run FROM m),
merged AS (SELECT call_id, min(label) AS label, min(human_id) AS human_id, floor((min(s)) * 100.0 + 0.5) / 100.0 AS start, floor((max(e)) * 100.0 + 0.5) / 100.0 AS "end", floor((sum(agreement * (e - s)) / sum(e - s)) * 1000.0 + 0.5) / 1000.0 AS agreement, min(n_voters) AS min_voters, bool_or(tie) AS has_tie FROM r GROUP BY call_id, run)
"""


def _merged(spark, d):
    voted = consensus.trusted_speaker(consensus.vote_intervals(segments(spark, d), calls(spark, d)))
    return consensus.merge_intervals(voted).select("call_id", "label", "human_id", "start", "end", "agreement", F.col("min_voters").cast("bigint").alias("min_voters"), "has_tie")


@query(_MERGED + "SELECT * FROM merged")
def merge_intervals(spark, d):
    return _merged(spark, d)


@query(_MERGED + """, reasoned AS (SELECT *, CASE WHEN has_tie THEN 'mandatory_tie' WHEN agreement >= 0.999 THEN 'spot_check_full' WHEN min_voters > 0 AND agreement >= 2.0 / min_voters - 1e-6 THEN 'spot_check_majority' ELSE 'mandatory_split' END AS reason,
  CAST(('0x' || left(md5(call_id || '|' || printf('%.2f', start)), 8)) AS BIGINT) / 4294967296.0 AS draw FROM merged)
SELECT call_id, start, "end", label, reason, CASE WHEN reason LIKE 'mandatory%' THEN true WHEN reason = 'spot_check_full' THEN draw < 0.12 ELSE draw < 0.30 END AS needs_review FROM reasoned""")
def review_routing(spark, d):
    return consensus.review_route(_merged(spark, d)).select("call_id", "start", "end", "label", "reason", "needs_review")


@query(_MERGED + """, mids AS (SELECT call_id, start, "end", label, (start + "end") / 2 AS mid FROM merged), trio AS (SELECT unnest(['asr_llm', 'gemini', 'gpt_audio']) AS labeler)
SELECT m.call_id, m.start, m."end", m.label, t.labeler, coalesce(arg_min(seg.label, seg.seq), 'unknown') AS model_label, floor((offset_s + m.start) * 1000.0 + 0.5) / 1000.0 AS abs_start, floor((offset_s + m."end") * 1000.0 + 0.5) / 1000.0 AS abs_end
FROM mids m CROSS JOIN trio t JOIN chunks ON chunk_id = m.call_id LEFT JOIN seg ON seg.call_id = m.call_id AND seg.labeler = t.labeler AND m.mid >= seg.s AND m.mid < seg.e AND seg.label IS NOT NULL GROUP BY m.call_id, m.start, m."end", m.label, t.labeler, offset_s""")
def gold_projection(spark, d):
    m = _merged(spark, d).withColumn("mid", (F.col("start") + F.col("end")) / 2).select("call_id", "start", "end", "label", "mid", F.explode(F.array(*map(F.lit, ("asr_llm", "gemini", "gpt_audio")))).alias("labeler"))
    s = segments(spark, d).filter("label IS NOT NULL").select("call_id", "labeler", "seq", F.col("start").alias("s"), F.col("end").alias("e"), F.col("label").alias("model_label"))
    hit = intervals.interval_join(m, s, ["call_id", "labeler"], "mid", "s", "e", how="left")
    got = hit.groupBy("call_id", "start", "end", "label", "labeler").agg(F.coalesce(F.min_by("model_label", "seq"), F.lit("unknown")).alias("model_label"))
    return got.join(table(spark, d, "chunks").select(F.col("chunk_id").alias("call_id"), "offset_s"), "call_id").select("call_id", "start", "end", "label", "labeler", "model_label", rounded(F.col("offset_s") + F.col("start"), 3).alias("abs_start"), rounded(F.col("offset_s") + F.col("end"), 3).alias("abs_end"))


# ---- ledgers -----------------------------------------------------------------------------------------------------------


@query("""WITH res AS (SELECT call_id, labeler, result_id, CASE WHEN max(raw_response) IS NULL THEN 'error' ELSE 'ok' END AS status FROM raw_segments WHERE call_id IS NOT NULL AND labeler IS NOT NULL GROUP BY 1, 2, 3), asked AS (SELECT DISTINCT call_id, labeler FROM labeler_segments)
SELECT call_id, labeler, EXISTS (SELECT 1 FROM res WHERE res.call_id = asked.call_id AND res.labeler = asked.labeler AND status = 'ok') AS cached FROM asked""")
def cache_plan(spark, d):
    res = table(spark, d, "raw_segments").groupBy("call_id", "labeler", "result_id").agg(F.when(F.max("raw_response").isNull(), "error").otherwise("ok").alias("status"))
    return ledger.cache_plan(table(spark, d, "labeler_segments").select("call_id", "labeler").distinct(), res, ["call_id", "labeler"])


_COST = """costs AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'gemini' WHEN 'N' THEN 'gpt_audio' ELSE 'asr_llm' END AS labeler, l_quantity * 1000 AS p, l_extendedprice AS c, l_quantity * 400 AS ai, CASE WHEN l_linestatus = 'O' THEN 'ok' ELSE 'error' END AS status, l_discount * 100 AS latency_s, o_totalprice / 100 AS duration_s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
priced AS (SELECT *, (greatest(0, p - ai) * ti + ai * au_in + greatest(0, c) * tt) / 1e6 AS cost_usd FROM costs JOIN (VALUES ('gemini', 1.5, 7.5, 1.5, 7.5), ('gpt_audio', 2.5, 10.0, 32.0, 64.0), ('asr_llm', 0.25, 2.0, 0.25, 2.0)) v(labeler, ti, tt, au_in, au_out) USING (labeler))"""


def _priced(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    li = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "gemini").when(F.col("l_returnflag") == "N", "gpt_audio").otherwise("asr_llm").alias("labeler"), (F.col("l_quantity") * 1000).alias("p"), F.col("l_extendedprice").alias("c"), (F.col("l_quantity") * 400).alias("ai"), F.when(F.col("l_linestatus") == "O", "ok").otherwise("error").alias("status"), (F.col("l_discount") * 100).alias("latency_s"), (F.col("o_totalprice") / 100).alias("duration_s"))
    # three price rows: the broadcast has a fixed size
    priced = li.join(F.broadcast(ledger.price_table(spark)), "labeler")
    return priced.withColumn("cost_usd", ledger.cost_usd(F.col("p"), F.col("c"), F.col("ai")))


@query("WITH " + _COST + " SELECT l_orderkey, l_linenumber, labeler, floor((cost_usd) * 1000000.0 + 0.5) / 1000000.0 AS cost_usd FROM priced")
def cost_ledger(spark, d):
    return _priced(spark, d).select("l_orderkey", "l_linenumber", "labeler", _r("cost_usd"))


@query("WITH " + _COST + """ SELECT l_orderkey, floor((coalesce(sum(k), 0)) * 1000000.0 + 0.5) / 1000000.0 AS cost_usd, bool_and(k IS NOT NULL OR status = 'error') AS cost_complete, count(*) FILTER (status = 'error') AS errors, floor((sum(latency_s) / max(duration_s)) * 1000000.0 + 0.5) / 1000000.0 AS rtf, floor((floor((coalesce(sum(k), 0)) * 1000000.0 + 0.5) / 1000000.0 / (max(duration_s) / 60)) * 1000000.0 + 0.5) / 1000000.0 AS cost_per_min
  FROM (SELECT *, CASE WHEN status = 'ok' THEN cost_usd END AS k FROM priced) GROUP BY 1""")
def chunk_costs(spark, d):
    rows = _priced(spark, d).withColumn("cost_usd", F.when(F.col("status") == "ok", F.col("cost_usd")))
    return ledger.chunk_costs(rows, "l_orderkey")


@query("WITH " + _COST + " SELECT status, labeler, CAST(grouping(status) AS INTEGER) AS all_chunks, CAST(grouping(labeler) AS INTEGER) AS all_labelers, count(*) AS n, round(sum(cost_usd), 4) AS cost_usd, sum(p) AS tokens FROM priced GROUP BY GROUPING SETS ((status), (labeler), ())")
def cost_rollup(spark, d):
    got = ledger.run_ledger(_priced(spark, d).withColumn("tokens", F.col("p")), "status", "labeler")
    return got.withColumns({c: F.col(c).cast("int") for c in ("all_chunks", "all_labelers")})


@query("SELECT event_id, CAST(coalesce(nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 0), 7) AS BIGINT) AS tokens FROM events")
def token_totals(spark, d):
    return table(spark, d, "events").select("event_id", ledger.token_total(F.get_json_object("props", "$.prompt").cast("bigint"), F.get_json_object("props", "$.k").cast("bigint"), F.lit(7).cast("bigint")).alias("tokens"))


@query("""SELECT clip_id, floor((lo) * 1000000.0 + 0.5) / 1000000.0 AS lo_s, floor((hi) * 1000000.0 + 0.5) / 1000000.0 AS hi_s, CAST(floor(lo * 8000) AS BIGINT) AS lo_sample, CAST(floor(hi * 8000) AS BIGINT) AS hi_sample FROM (
  SELECT clip_id, greatest(0, CAST(clip_start AS DOUBLE) - 0.5) AS lo, least(duration_s, CAST(clip_end AS DOUBLE) + 0.5) AS hi FROM clips JOIN chunks ON call_id = chunk_id)""")
def clip_bounds(spark, d):
    c = table(spark, d, "clips").select("clip_id", "call_id", F.col("clip_start").cast("double").alias("start"), F.col("clip_end").cast("double").alias("end")).join(calls(spark, d), "call_id")
    return intervals.padded_bounds(c, "duration_s", 0.5).select("clip_id", _r("lo_s"), _r("hi_s"), "lo_sample", "hi_sample")


_REVIEW = """last AS (SELECT call_id, s, e, final FROM (SELECT call_id, clip_start AS s, clip_end AS e, CASE WHEN reviewed THEN final_label END AS final, row_number() OVER (PARTITION BY call_id, clip_start, clip_end ORDER BY published_ts DESC NULLS LAST, clip_id DESC) AS k FROM clips) WHERE k = 1)"""


def _last_reviews(spark, d):
    c = table(spark, d, "clips").select("call_id", "clip_start", "clip_end", F.when(F.col("reviewed"), F.col("final_label")).alias("final_label"), "published_ts", "clip_id")
    return ledger.latest(c, ["call_id", "clip_start", "clip_end"], ["published_ts", "clip_id"])


@query("WITH " + _REVIEW + " SELECT call_id, s AS clip_start, e AS clip_end, final AS final_label FROM last")
def review_latest(spark, d):
    return _last_reviews(spark, d).select("call_id", "clip_start", "clip_end", "final_label")


@query("WITH " + _REVIEW + " SELECT clip_id, coalesce(final, label) AS final_label, final IS NOT NULL AS reviewed FROM clips LEFT JOIN last ON clips.call_id = last.call_id AND clip_start = s AND clip_end = e")
def review_override(spark, d):
    g = table(spark, d, "clips").select("clip_id", "call_id", "clip_start", "clip_end", "label")
    return ledger.published(g, _last_reviews(spark, d), ["call_id", "clip_start", "clip_end"]).select("clip_id", "final_label", "reviewed")


@query("SELECT call_id, labeler, count(*) AS n, round(sum(coalesce(confidence, 0.5)), 6) AS confidence FROM labeler_segments WHERE NOT isnan(seg_end) AND seg_end IS NOT NULL AND seg_start IS NOT NULL AND (confidence IS NULL OR NOT isnan(confidence)) GROUP BY 1, 2")
def parsed_answers(spark, d):
    from callweave.sources.records import parse_segments

    s = table(spark, d, "labeler_segments").filter("seg_end IS NOT NULL AND seg_start IS NOT NULL AND NOT isnan(seg_end) AND (confidence IS NULL OR NOT isnan(confidence))")
    raw = s.groupBy("call_id", "labeler").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "label", "confidence", "evidence", "human_id")).alias("segments"))).alias("raw"))
    got = raw.select("call_id", "labeler", F.explode(parse_segments(F.concat(F.lit("```json\n"), "raw", F.lit("\n```")))).alias("x"))
    return got.groupBy("call_id", "labeler").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x.confidence"), 6).alias("confidence"))


@query("""SELECT call_id, string_agg(line, chr(10) ORDER BY start_s, turn_id) AS transcript FROM (SELECT call_id, turn_id, start_s, CASE WHEN start_s - lag(end_s) OVER w > 1.5 THEN '[SILENCE ' || printf('%.1f', start_s - lag(end_s) OVER w) || 's] ' ELSE '' END || text AS line FROM gold_turns WHERE call_id IS NOT NULL AND start_s IS NOT NULL WINDOW w AS (PARTITION BY call_id ORDER BY start_s, turn_id)) WHERE line IS NOT NULL GROUP BY 1""")
def transcript(spark, d):
    w = timeseries.W.partitionBy("call_id").orderBy("start_s", "turn_id")
    t = table(spark, d, "gold_turns").filter("call_id IS NOT NULL AND start_s IS NOT NULL").withColumn("line", F.concat(text.transcript_gap(F.coalesce(F.col("start_s") - F.lag("end_s").over(w), F.lit(0.0))), F.col("text")))
    lines = t.filter("line IS NOT NULL").groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "turn_id", "line"))).alias("x"))
    return lines.select("call_id", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("transcript"))


# ---- ordered rows ------------------------------------------------------------------------------------------------------

_RUNS = "WITH " + HOPS + """, m AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS st FROM hops WINDOW w AS (PARTITION BY call_id ORDER BY t_s, row_id)), r AS (SELECT *, sum(st) OVER (PARTITION BY call_id ORDER BY t_s, row_id) AS run FROM m)
"""


@query(_RUNS + "SELECT call_id, min(t_s) AS start_s, round(max(t_s) + 0.5, 3) AS end_s, min(state) AS state, count(*) AS hops FROM r GROUP BY call_id, run")
def segment_timeline(spark, d):
    return timeseries.segment_timeline(hops(spark, d), labels=False).select("call_id", "start_s", "end_s", "state", "hops")


_MODAL = _RUNS.rstrip() + """, subs AS (SELECT call_id, run, sub_label FROM (SELECT call_id, run, sub_label, row_number() OVER (PARTITION BY call_id, run ORDER BY count(*) DESC, min(t_s)) AS k FROM r WHERE sub_label IS NOT NULL GROUP BY 1, 2, 3) WHERE k = 1),
segs AS (SELECT call_id, run, min(t_s) AS start_s, round(max(t_s) + 0.5, 3) AS end_s, min(state) AS state, count(*) AS hops, round(avg(confidence), 3) AS mean_confidence, arg_min(speaker_id, t_s) FILTER (speaker_id IS NOT NULL) AS speaker_id, first(row_id ORDER BY confidence DESC NULLS LAST, t_s) AS best_row FROM r GROUP BY 1, 2)
"""


@query(_MODAL + "SELECT call_id, start_s, end_s, state, hops, mean_confidence, speaker_id, best_row, sub_label FROM segs LEFT JOIN subs USING (call_id, run)")
def segment_timeline_modal(spark, d):
    return timeseries.segment_timeline(hops(spark, d))


@query("WITH " + HOPS + """, e AS (SELECT lower(trim(call_id)) AS call_id, t_s, regexp_replace(lower(kind), '[^a-z]', '', 'g') AS kind FROM telephony WHERE call_id IS NOT NULL AND t_s IS NOT NULL),
leg AS (SELECT DISTINCT call_id, t_s FROM e WHERE kind IN ('siplegchanged', 'participantchanged')), dt AS (SELECT DISTINCT call_id, t_s FROM e WHERE kind = 'dtmf'),
x AS (SELECT h.row_id, h.t_s, leg.t_s AS last_leg_s FROM hops h ASOF LEFT JOIN leg ON h.call_id = leg.call_id AND h.t_s >= leg.t_s), y AS (SELECT h.row_id, dt.t_s AS last_dtmf_s FROM hops h ASOF LEFT JOIN dt ON h.call_id = dt.call_id AND h.t_s >= dt.t_s)
SELECT row_id, last_leg_s, last_dtmf_s, round(least(coalesce(t_s - last_leg_s, 30), 30), 6) AS since_leg_s, coalesce(t_s - last_leg_s <= 3, false) AS leg_recent, coalesce(t_s - last_dtmf_s <= 3, false) AS dtmf_recent FROM x JOIN y USING (row_id)""")
def asof_signal(spark, d):
    e = table(spark, d, "telephony").filter("call_id IS NOT NULL AND t_s IS NOT NULL").select(F.lower(F.trim("call_id")).alias("call_id"), "t_s", timeseries.state_name(F.col("kind")).alias("kind"))
    got = timeseries.asof_flags(hops(spark, d).select("call_id", "t_s", "row_id"), e, "call_id", "t_s", {"leg": ("siplegchanged", "participantchanged"), "dtmf": ("dtmf",)})
    return got.select("row_id", "last_leg_s", "last_dtmf_s", "since_leg_s", "leg_recent", "dtmf_recent")


@query("WITH " + HOPS + """ SELECT call_id, k * 2.0 AS hop_end, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM hops, unnest(range(CAST(ceil(t_s / 2.0) AS BIGINT), CAST(ceil(t_s / 2.0) AS BIGINT) + 3)) t(k) WHERE t_s > k * 2.0 - 6.0 GROUP BY 1, 2""")
def hopping_window(spark, d):
    got = timeseries.hopping_windows(hops(spark, d).select("call_id", "t_s", "confidence"), "call_id", "t_s", 6.0, 2.0, {"n": F.count(F.lit(1)), "mean_confidence": F.avg("confidence")})
    return got.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""SELECT obs_id, count(*) OVER w AS windows, CAST(sum(n) OVER w AS BIGINT) AS words, round(sum(n) OVER w / 20.0, 6) AS rate FROM (SELECT obs_id, call_id, CAST(round(t_s * 1000) AS BIGINT) AS ms, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS n FROM semantic_obs WHERE t_s IS NOT NULL AND call_id IS NOT NULL)
WINDOW w AS (PARTITION BY call_id ORDER BY ms RANGE BETWEEN 20000 PRECEDING AND CURRENT ROW)""")
def rolling_text_rate(spark, d):
    o = table(spark, d, "semantic_obs").filter("t_s IS NOT NULL AND call_id IS NOT NULL").select("obs_id", "call_id", F.round(F.col("t_s") * 1000).cast("bigint").alias("ms"), F.size(text.tokens(F.col("text"))).alias("n"))
    got = timeseries.trailing(o, "call_id", "ms", 20.0, {"windows": F.count(F.lit(1)), "words": F.sum("n")})
    return got.select("obs_id", "windows", "words", F.round(F.col("words") / 20.0, 6).alias("rate"))


@query("WITH " + HOPS + " SELECT row_id, floor((avg(confidence) OVER w) * 1000000.0 + 0.5) / 1000000.0 AS confidence_mean, floor((confidence - avg(confidence) OVER w) * 1000000.0 + 0.5) / 1000000.0 AS confidence_delta FROM hops WINDOW w AS (PARTITION BY call_id ORDER BY t_s, row_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def context_delta(spark, d):
    return timeseries.context_delta(hops(spark, d), "call_id", ["t_s", "row_id"], ["confidence"]).select("row_id", _r("confidence_mean"), _r("confidence_delta"))


@query("WITH " + HOPS + " SELECT row_id, list(state) OVER (PARTITION BY call_id ORDER BY t_s, row_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS buffer FROM hops")
def ring_buffer(spark, d):
    return timeseries.ring_buffer(hops(spark, d), "call_id", ["t_s", "row_id"], "state", 4).select("row_id", "buffer")


@query("WITH " + HOPS + """, x AS (SELECT *, lag(state) OVER w AS ps, last_value(speaker_id IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY t_s, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM hops WINDOW w AS (PARTITION BY call_id ORDER BY t_s, row_id))
SELECT call_id, t_s, 'ivr_exit' AS event_type FROM x WHERE ps = 'ivr' AND state <> 'ivr' UNION ALL SELECT call_id, t_s, 'speaker_changed' FROM x WHERE speaker_id <> pv UNION ALL SELECT call_id, t_s, 'human_joined' FROM x WHERE state = 'human' AND ps IS DISTINCT FROM 'human'""")
def boundary_events(spark, d):
    return timeseries.boundary_events(hops(spark, d))


@query("WITH " + HOPS + """, x AS (SELECT row_id, call_id, t_s, CASE WHEN lag(state) OVER w <> state THEN lag(state) OVER w END AS b FROM hops WINDOW w AS (PARTITION BY call_id ORDER BY t_s, row_id))
SELECT row_id, last_value(b IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY t_s, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous_state FROM x""")
def previous_state(spark, d):
    return timeseries.previous_distinct_state(hops(spark, d)).select("row_id", "previous_state")


def _hmm_sql() -> str:
    a = sequence.transition_matrix()
    raw = ", ".join("(" + " + ".join(f"acc.a[{i + 1}] * {a[i, j]!r}" for i in range(4)).replace("np.float64(", "").replace(")", "") + f") * greatest(x.b[{j + 1}], 1e-4)" for j in range(4))
    return "WITH " + HOPS + f""", em AS (SELECT call_id, row_id, t_s, list_transform(['ivr', 'human', 'hold', 'other'], lambda s: CASE WHEN s = state THEN c ELSE (1 - c) / 3 END) AS b FROM (SELECT *, coalesce(least(greatest(confidence, 0.0), 1.0), 0.25) AS c FROM hops)),
seqs AS (SELECT call_id, list({{'r': row_id, 't': t_s, 'b': b, 'a': [0.45, 0.2, 0.2, 0.15], 's': 0, 'e': CAST(0 AS DOUBLE), 'p': CAST([] AS DOUBLE[])}} ORDER BY t_s, row_id) AS xs FROM em GROUP BY 1)
SELECT row_id, round(p[1], 6) AS p_ivr, round(p[2], 6) AS p_human, round(p[3], 6) AS p_hold, round(p[4], 6) AS p_other, ['ivr', 'human', 'hold', 'other'][s] AS state, round(p[s], 6) AS confidence, round(greatest(0, t - e), 3) AS dwell_s FROM (WITH RECURSIVE walk AS (
  SELECT call_id, 1 AS i, list_transform([xs[1]], lambda x: {_hmm_step(raw, first=True)})[1] AS v FROM seqs
  UNION ALL SELECT w.call_id, w.i + 1, list_transform([{{'acc': w.v, 'x': q.xs[w.i + 1]}}], lambda z: {_hmm_step(raw.replace('acc.', 'z.acc.').replace('x.b', 'z.x.b'), first=False)})[1] FROM walk w JOIN seqs q ON q.call_id = w.call_id AND w.i < len(q.xs))
  SELECT v.r AS row_id, v.p AS p, v.s AS s, v.t AS t, v.e AS e FROM walk)"""


def _hmm_step(raw: str, first: bool) -> str:
    if first:
        raw, r, t, b, s0, e0 = raw.replace("acc.a", "x.a"), "x.r", "x.t", "x.b", "0", "x.e"
    else:
        r, t, b, s0, e0 = "z.x.r", "z.x.t", "z.x.b", "z.acc.s", "z.acc.e"
    top = "list_position(p, list_max(p))"
    new = f"({s0} = 0 OR ({top} <> {s0} AND list_max(p) >= 0.45))"
    return f"list_transform([[{raw}]], lambda w4: list_transform([list_transform(w4, lambda v4: v4 / list_sum(w4))], lambda p: {{'r': {r}, 't': {t}, 'b': {b}, 'a': list_transform(p, lambda v5: greatest(v5, 1e-12)), 's': CASE WHEN {new} THEN {top} ELSE {s0} END, 'e': CASE WHEN {new} THEN {t} ELSE {e0} END, 'p': p}})[1])[1]"


@query(_hmm_sql())
def hmm_filter(spark, d):
    em = sequence.emissions(hops(spark, d).select("call_id", "row_id", "t_s", "state", "confidence"))
    return sequence.hmm_filter(em).select("row_id", "p_ivr", "p_human", "p_hold", "p_other", "state", "confidence", "dwell_s")


@query()
def transfer_fsm(spark, d):
    h = hops(spark, d)
    e = table(spark, d, "telephony").filter("call_id IS NOT NULL AND t_s IS NOT NULL").select(F.lower(F.trim("call_id")).alias("call_id"), "t_s", timeseries.state_name(F.col("kind")).alias("kind"))
    obs = table(spark, d, "semantic_obs").filter("call_id IS NOT NULL AND t_s IS NOT NULL")
    o = obs.filter("transfer_phrase_prob >= 0.5").select("call_id", "t_s", F.lit("phrase").alias("kind"), F.lit(None).cast("double").alias("fail"))
    score = text.phrase_score(text.normalize(F.col("text")), lexicon.TRANSFER_FAIL)
    said = obs.filter("text IS NOT NULL").select("call_id", "t_s", F.lit("fail").alias("kind"), score.alias("fail")).filter("fail > 0")
    rows = transfer_inputs(h, e, o.unionByName(said))
    return sequence.transfer_events(rows)


def transfer_inputs(h, carrier, spoken):
    """Rows of transfer_events() from hops, carrier events (call_id, t_s, kind) and spoken phrases (call_id, t_s, kind 'phrase' or 'fail', fail score): what was said within 0.5 s before a hop counts for it, and a speaker is new at their first hop of the call."""
    events = carrier.unionByName(spoken.select("call_id", "t_s", "kind"))
    near = timeseries.asof_flags(h.select("call_id", "t_s", "row_id", "state", "speaker_id", "confidence"), events, "call_id", "t_s", {"leg": ("siplegchanged", "participantchanged"), "phrase": ("phrase",), "fail": ("fail",)}, within_s=3.0)
    scores = spoken.filter("kind = 'fail'").groupBy("call_id", F.col("t_s").alias("last_fail_s")).agg(F.max("fail").alias("_fail"))
    near = near.join(scores, ["call_id", "last_fail_s"], "left")
    run = ordered.runs(near, ["call_id"], ["t_s", "row_id"], F.col("state")).withColumn("_t0", F.col("_run.t_s"))
    # a speaker's first hop: one row per call and speaker
    met = near.filter("speaker_id IS NOT NULL").groupBy("call_id", "speaker_id").agg(F.min(F.struct("t_s", "row_id")).alias("_met"))
    run = run.join(met, ["call_id", "speaker_id"], "left").withColumn("is_new", F.coalesce(F.col("_met") == F.struct("t_s", "row_id"), F.lit(False)))
    recent = lambda name: F.col(f"{name}_recent") & (F.col(f"since_{name}_s") < 0.5)
    fail = F.when(recent("fail"), F.col("_fail")).otherwise(0.0)
    return run.select("call_id", "row_id", "t_s", "state", "speaker_id", "is_new", F.when(recent("phrase"), 0.9).otherwise(0.0).alias("transfer_phrase"), fail.alias("transfer_fail"), "confidence", F.col("leg_recent").alias("leg_changed"), (F.col("t_s") - F.col("_t0")).alias("dwell_s"))


@query()
def speaker_registry(spark, d):
    return sequence.speaker_registry(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.5)


@query()
def dedup_words(spark, d):
    o = table(spark, d, "semantic_obs").filter("call_id IS NOT NULL AND t_s IS NOT NULL AND text IS NOT NULL")
    words = F.transform(text.tokens(F.col("text")), lambda w, i: F.struct((F.col("t_s") + i * 0.25).alias("start_s"), w.alias("text")))
    # every window also hears the words of the window before
    windows = ordered.before(o.select("call_id", "t_s", "obs_id", words.alias("own")), ["call_id"], ["t_s", "obs_id"], {"earlier": F.col("own")})
    both = F.concat(F.coalesce("earlier", F.filter("own", lambda x: F.lit(False))), "own")
    return sequence.dedup_words(windows.select("call_id", (F.col("t_s") + 3.0).alias("window_end_s"), both.alias("words")), "call_id")


_FRAMES = """fr AS (SELECT call_id, t_s, row_id, 20 * log10(greatest(latency_ms, 0.001)) AS db FROM timeline WHERE call_id IS NOT NULL AND t_s IS NOT NULL AND latency_ms IS NOT NULL),
th AS (SELECT call_id, quantile_cont(db, 0.25) AS lo, quantile_cont(db, 0.95) AS hi FROM fr GROUP BY 1)"""


def _frames(spark, d):
    fr = table(spark, d, "timeline").filter("call_id IS NOT NULL AND t_s IS NOT NULL AND latency_ms IS NOT NULL").select("call_id", "t_s", "row_id", (20 * F.log10(F.greatest("latency_ms", F.lit(0.001)))).alias("db"))
    th = ordered.percentiles(fr, ["call_id"], "db", {"lo": 0.25, "hi": 0.95}).drop("_n")
    return fr.join(th, "call_id").withColumn("speech", F.when(F.col("hi") - F.col("lo") < 3, F.col("hi") > -45).otherwise(F.col("db") > F.col("lo") + 9))


@query("WITH " + _FRAMES + """, f AS (SELECT *, CASE WHEN hi - lo < 3 THEN hi > -45 ELSE db > lo + 9 END AS sp FROM fr JOIN th USING (call_id)), m AS (SELECT *, CASE WHEN lag(sp) OVER w = sp THEN 0 ELSE 1 END AS st FROM f WINDOW w AS (PARTITION BY call_id ORDER BY t_s, row_id)), r AS (SELECT *, sum(st) OVER (PARTITION BY call_id ORDER BY t_s, row_id) AS run FROM m)
SELECT row_id, sp AND (hi - lo < 3 OR count(*) OVER (PARTITION BY call_id, run) >= 3) AS speech FROM r""")
def vad_frames(spark, d):
    f = ordered.runs(_frames(spark, d), ["call_id"], ["t_s", "row_id"], F.col("speech"))
    # runs of one or two frames are few rows; they are marked where they lie, so that a long run is never brought together
    short = f.filter("speech").groupBy("call_id", "_run").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(F.min("_bin"), F.max("_bin"))).alias("bins")).filter("n < 3")
    short = short.select("call_id", "_run", F.explode("bins").alias("_bin"), F.lit(True).alias("_short"))
    got = f.join(short, ["call_id", "_bin", "_run"], "left")
    return got.select("row_id", (F.col("speech") & ((F.col("hi") - F.col("lo") < 3) | F.col("_short").isNull())).alias("speech"))


@query()
def silence_segments(spark, d):
    return sequence.silence_segments(_frames(spark, d).select("call_id", "t_s", "speech"), "call_id", 0.5, quiet_s=1.0, least_s=1.5, most_s=20.0)


# ---- text --------------------------------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9'']+', ' ', 'g'))"
_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9'']+')"


@query(f"SELECT turn_id, {_NORM.format('text')} AS normal FROM gold_turns")
def text_normalize(spark, d):
    return table(spark, d, "gold_turns").select("turn_id", text.normalize(F.col("text")).alias("normal"))


@query(f"""WITH t AS (SELECT turn_id, {_TOKENS.format('text')} AS ts FROM gold_turns)
SELECT gram, count(*) AS n FROM (SELECT unnest(ts || list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1])) AS gram FROM t) GROUP BY 1""")
def token_ngrams(spark, d):
    return table(spark, d, "gold_turns").select(F.explode(text.ngrams(text.tokens(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _hits(patterns: list[str]) -> str:
    return "(" + " + ".join("CAST(regexp_matches(n, '{}') AS INTEGER)".format(p.replace("'", "''")) for p in patterns) + ")"


def _score(patterns: list[str]) -> str:
    h = _hits(patterns)
    return f"CASE WHEN {h} > 0 THEN least(1.0, 0.55 + 0.2 * {h}) ELSE 0.0 END"


_MARK = ", ".join("'" + m.replace("'", "''") + "'" for m in lexicon.MARKERS)
_LEX = f"""t AS (SELECT turn_id, {_NORM.format('text')} AS n, {_TOKENS.format('text')} AS ts FROM gold_turns)"""


@query(f"""WITH {_LEX} SELECT turn_id, round({_score(lexicon.IVR)}, 6) AS ivr, round({_score(lexicon.HOLD)}, 6) AS hold, round({_score(lexicon.TRANSFER)}, 6) AS transfer, round({_score(lexicon.TRANSFER_FAIL)}, 6) AS transfer_fail,
  round(least(1.0, 0.54 * least((CASE WHEN len(ts) > 0 THEN len(list_filter(ts, lambda w: w IN ({_MARK}))) / len(ts) ELSE 0 END) / 0.12, 1.0) + 0.7 * ({_score(lexicon.HUMAN)})), 6) AS spontaneous FROM t""")
def lexicon_scores(spark, d):
    n, ts = F.col("n"), F.col("ts")
    t = table(spark, d, "gold_turns").select("turn_id", text.normalize(F.col("text")).alias("n"), text.tokens(F.col("text")).alias("ts"))
    named = {"ivr": lexicon.IVR, "hold": lexicon.HOLD, "transfer": lexicon.TRANSFER, "transfer_fail": lexicon.TRANSFER_FAIL}
    return t.select("turn_id", *[F.round(text.phrase_score(n, p), 6).alias(k) for k, p in named.items()], F.round(text.spontaneous_score(n, ts, lexicon.HUMAN, lexicon.MARKERS), 6).alias("spontaneous"))


_FAMILY_ROWS = ", ".join("('{}', '{}')".format(k, p.replace("'", "''")) for k, ps in lexicon.FAMILIES.items() for p in ps)


@query(f"""WITH {_LEX}, p(family, pattern) AS (VALUES {_FAMILY_ROWS}) SELECT family, pattern, count(*) AS n FROM t JOIN p ON regexp_matches(t.n, p.pattern) GROUP BY 1, 2""")
def lexicon_hits(spark, d):
    t = table(spark, d, "gold_turns").select(text.normalize(F.col("text")).alias("n"))
    hits = [F.transform(text.phrase_hits(F.col("n"), ps), lambda x, k=k: F.struct(F.lit(k).alias("family"), x.alias("pattern"))) for k, ps in lexicon.FAMILIES.items()]
    return t.select(F.explode(F.concat(*hits)).alias("x")).groupBy("x.family", "x.pattern").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT turn_id, {_TOKENS.format('text')} AS ts FROM gold_turns)
SELECT gram, count(*) AS n FROM (SELECT unnest(ts || list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1])) AS gram FROM t) GROUP BY 1""")
def token_ngrams(spark, d):
    return table(spark, d, "gold_turns").select(F.explode(text.ngrams(text.tokens(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _hits(patterns: list[str]) -> str:
    return "(" + " + ".join("CAST(regexp_matches(n, '{}') AS INTEGER)".format(p.replace("'", "''")) for p in patterns) + ")"


def _score(patterns: list[str]) -> str:
    h = _hits(patterns)
    return f"CASE WHEN {h} > 0 THEN least(1.0, 0.55 + 0.2 * {h}) ELSE 0.0 END"


_MARK = ", ".join("'" + m.replace("'", "''") + "'" for m in lexicon.MARKERS)
_LEX = f"""t AS (SELECT turn_id, {_NORM.format('text')} AS n, {_TOKENS.format('text')} AS ts FROM gold_turns)"""


@query(f"""WITH {_LEX} SELECT turn_id, round({_score(lexicon.IVR)}, 6) AS ivr, round({_score(lexicon.HOLD)}, 6) AS hold, round({_score(lexicon.TRANSFER)}, 6) AS transfer, round({_score(lexicon.TRANSFER_FAIL)}, 6) AS transfer_fail,
  round(least(1.0, 0.54 * least((CASE WHEN len(ts) > 0 THEN len(list_filter(ts, lambda w: w IN ({_MARK}))) / len(ts) ELSE 0 END) / 0.12, 1.0) + 0.7 * ({_score(lexicon.HUMAN)})), 6) AS spontaneous FROM t""")
def lexicon_scores(spark, d):
    n, ts = F.col("n"), F.col("ts")
    t = table(spark, d, "gold_turns").select("turn_id", text.normalize(F.col("text")).alias("n"), text.tokens(F.col("text")).alias("ts"))
    named = {"ivr": lexicon.IVR, "hold": lexicon.HOLD, "transfer": lexicon.TRANSFER, "transfer_fail": lexicon.TRANSFER_FAIL}
    return t.select("turn_id", *[F.round(text.phrase_score(n, p), 6).alias(k) for k, p in named.items()], F.round(text.spontaneous_score(n, ts, lexicon.HUMAN, lexicon.MARKERS), 6).alias("spontaneous"))


@query(f"""WITH {_LEX} SELECT p AS pattern, count(*) AS n FROM (SELECT unnest(list_filter([{", ".join("'" + p.replace("'", "''") + "'" for p in lexicon.HOLD + lexicon.TRANSFER)}], lambda p: regexp_matches(n, p))) AS p FROM t) GROUP BY 1""")
def lexicon_hits(spark, d):
    t = table(spark, d, "gold_turns").select(text.normalize(F.col("text")).alias("n"))
    return t.select(F.explode(text.phrase_hits(F.col("n"), lexicon.HOLD + lexicon.TRANSFER)).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT turn_id, {_TOKENS.format('text')} AS ts FROM gold_turns), g AS (SELECT turn_id, unnest(ts || list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1])) AS gram FROM t),
h AS (SELECT turn_id, CAST('0x' || left(md5(gram), 9) AS BIGINT) AS h FROM g), b AS (SELECT turn_id, h % 16 AS bucket, sum(CASE WHEN (h >> 32) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM h GROUP BY 1, 2), nn AS (SELECT turn_id, sqrt(sum(v * v)) AS n FROM b GROUP BY 1)
SELECT turn_id, bucket, floor((v / n) * 1000000.0 + 0.5) / 1000000.0 AS value FROM b JOIN nn USING (turn_id) WHERE v <> 0""")
def hashed_embedding(spark, d):
    t = table(spark, d, "gold_turns").select("turn_id", text.ngrams(text.tokens(F.col("text"))).alias("grams")).filter("size(grams) > 0")
    return text.hashed_embedding(t, "turn_id", "grams", 16).select("turn_id", "bucket", _r("value"))


_OBS_SQL = "(SELECT obs_id, text, coalesce(word_rate, 0) AS word_rate, coalesce(ivr_prompt_prob, 0) AS i, coalesce(hold_phrase_prob, 0) AS h, coalesce(human_spontaneous_prob, 0) AS m FROM semantic_obs)"


@query("""SELECT obs_id, CASE WHEN h >= 0.5 THEN 'queue' WHEN i >= 0.5 THEN CASE WHEN regexp_matches(n, '\\b(press|keypad|pound)\\b') THEN 'keypad_menu' ELSE 'speech_ivr' END WHEN m >= 0.5 THEN 'conversational' WHEN m >= 0.3 THEN NULL ELSE 'unclassified' END AS sub_label FROM (SELECT *, """ + _NORM.format("text") + " AS n FROM " + _OBS_SQL + ")")
def sub_label(spark, d):
    o = _obs(spark, d)
    state = F.when(F.col("hold_phrase_prob") >= 0.5, "hold").when(F.col("ivr_prompt_prob") >= 0.5, "ivr").when(F.col("human_spontaneous_prob") >= 0.3, "human").otherwise("other")
    zero = F.lit(0.0)
    return o.select("obs_id", text.sub_label(state, zero, zero, zero, zero, F.col("human_spontaneous_prob"), F.col("text"), F.col("ivr_prompt_prob")).alias("sub_label"))


def _obs(spark, d):
    o = table(spark, d, "semantic_obs")
    return o.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("word_rate", "ivr_prompt_prob", "hold_phrase_prob", "human_spontaneous_prob", "transfer_phrase_prob", "asr_confidence")})


@query("""SELECT turn_id, i AS k, toks[i + 1] AS word, floor((start_s + i * (end_s - start_s) / len(toks)) * 1000000.0 + 0.5) / 1000000.0 AS word_s FROM (SELECT turn_id, start_s, end_s, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS toks FROM gold_turns WHERE end_s > start_s AND call_id IS NOT NULL) x, unnest(range(0, len(toks))) t(i)""")
def scripted_words(spark, d):
    t = gold(spark, d).select("turn_id", "start_s", "end_s", text.tokens(F.col("text")).alias("toks"))
    w = t.select("turn_id", "start_s", "end_s", F.size("toks").alias("n"), F.posexplode("toks").alias("k", "word"))
    return w.select("turn_id", F.col("k").cast("bigint").alias("k"), "word", rounded(F.col("start_s") + F.col("k") * (F.col("end_s") - F.col("start_s")) / F.col("n"), 6).alias("word_s"))


# ---- evidence and models -----------------------------------------------------------------------------------------------


def _linear_sql() -> str:
    fs = {"ivr_prompt_prob": "i", "hold_phrase_prob": "h", "human_spontaneous_prob": "m", "word_rate": "least(word_rate / 4, 1.5)", "has_text": "CASE WHEN trim(coalesce(text, '')) <> '' THEN 1.0 ELSE 0.0 END"}
    return ", ".join(" + ".join([repr(models.BIAS[k]), *[f"{c} * ({models.WEIGHTS[f][k]!r})" for f, c in fs.items()]]) + f" AS s{k}" for k in range(4))


_LIN = f"x AS (SELECT obs_id, {_linear_sql()} FROM {_OBS_SQL}), y AS (SELECT *, greatest(s0, s1, s2, s3) AS top FROM x), z AS (SELECT *, exp(s0 - top) + exp(s1 - top) + exp(s2 - top) + exp(s3 - top) + 1e-12 AS n FROM y)"


@query(f"WITH {_LIN} SELECT obs_id, floor((exp(s0 - top) / n) * 1000000.0 + 0.5) / 1000000.0 AS p_ivr, floor((exp(s1 - top) / n) * 1000000.0 + 0.5) / 1000000.0 AS p_human, floor((exp(s2 - top) / n) * 1000000.0 + 0.5) / 1000000.0 AS p_hold, floor((exp(s3 - top) / n) * 1000000.0 + 0.5) / 1000000.0 AS p_other, CASE top WHEN s0 THEN 'ivr' WHEN s1 THEN 'human' WHEN s2 THEN 'hold' ELSE 'other' END AS state FROM z")
def linear_evidence(spark, d):
    got = models.prior_evidence(_scalars(spark, d))
    return got.select("obs_id", *[_r(f"p_{s}") for s in models.STATES], "state")


def _scalars(spark, d):
    # evidence of words only: the acoustic scalars are absent and neutral
    return models.clipped_scalars(_obs(spark, d))


@query()
def top_contributions(spark, d):
    got = models.prior_evidence(_scalars(spark, d))
    return got.select("obs_id", "state", models.contributions(F.col("state"), 4).alias("top"), models.evidence(F.col("state"), F.col("text")).alias("evidence"))


_TEMPS = ", ".join(str(round(0.5 + 0.05 * i, 2)) for i in range(71))


@query(f"""WITH {_LIN} SELECT CAST(t AS DOUBLE) AS temperature, round(avg(-ln(exp((s - top) / t) / (exp((s0 - top) / t) + exp((s1 - top) / t) + exp((s2 - top) / t) + exp((s3 - top) / t) + 1e-12) + 1e-12)), 6) AS nll FROM (SELECT z.*, [s0, s1, s2, s3][y] AS s FROM z JOIN (SELECT obs_id, list_position(['ivr', 'human', 'hold', 'other'], arg_min(g.state, g.turn_id)) AS y FROM semantic_obs o JOIN gold_turns g ON o.call_id = g.call_id AND o.t_s >= g.start_s AND o.t_s < g.end_s WHERE g.state IS NOT NULL GROUP BY 1) USING (obs_id) WHERE y > 0), (SELECT unnest([{_TEMPS}]) AS t) GROUP BY 1""")
def temperature_grid(spark, d):
    g = gold(spark, d).filter("state IS NOT NULL").select("call_id", "turn_id", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.col("state").alias("_g"))
    o = table(spark, d, "semantic_obs").filter("call_id IS NOT NULL AND t_s IS NOT NULL").select("obs_id", "call_id", F.col("t_s").alias("_at"))
    y = F.array_position(F.array(*map(F.lit, models.STATES)), F.col("_g")).cast("int") - 1
    label = intervals.interval_join(o, g, ["call_id"], "_at", "_s", "_e").groupBy("obs_id").agg(F.min_by("_g", "turn_id").alias("_g")).select("obs_id", y.alias("y")).filter("y >= 0")
    named = _scalars(spark, d).select("obs_id", *[x.alias(f"s{k}") for k, x in enumerate(models.scores())]).join(label, "obs_id")
    return models.temperature_grid(named, ["s0", "s1", "s2", "s3"], "y")


@query("""SELECT call_id, stratum, k <= CASE WHEN n > 1 THEN greatest(1, CAST(round_even(n * 0.34, 0) AS INTEGER)) ELSE 0 END AS is_holdout FROM (SELECT chunk_id AS call_id, chunk_index % 5 AS stratum, count(*) OVER (PARTITION BY chunk_index % 5) AS n, row_number() OVER (PARTITION BY chunk_index % 5 ORDER BY md5('7|' || chunk_id), chunk_id) AS k FROM chunks)""")
def stratified_split(spark, d):
    return models.stratified_holdout(table(spark, d, "chunks").select(F.col("chunk_id").alias("call_id"), (F.col("chunk_index") % 5).alias("stratum")), "call_id", "stratum")


@query()
def logistic_fit(spark, d):
    _, _, scored = models.fit_logistic(table(spark, d, "embeddings"), "embedding", "label")
    return scored.groupBy("label", F.col("prediction").cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


_PROJECT = ", ".join(f"round(tanh(list_inner_product(e, {[row[j] for row in models.random_projection(64, 8, 5)]})), 6)" for j in range(8))


@query(f"SELECT vec_id, CASE WHEN len(e) = 64 THEN [{_PROJECT}] ELSE [0.0, 0, 0, 0, 0, 0, 0, 0] END AS projected FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def random_projection(spark, d):
    m = models.random_projection(64, 8, 5)
    return table(spark, d, "embeddings").select("vec_id", F.transform(models.project(F.col("embedding"), m), lambda x: F.round(x, 6)).alias("projected"))


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT query_id, vec_id, cosine FROM (SELECT q.vec_id AS query_id, p.vec_id, round(list_cosine_similarity(q.e, p.e), 6) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, p.e), 6) DESC, p.vec_id) AS k FROM q JOIN p ON q.vec_id <> p.vec_id) WHERE k <= 3""")
def nearest_vectors(spark, d):
    """The query set (ids divisible by 20) against all rows, in blocks of bounded size by an Arrow pass: block products, local top 3, global top 3."""
    from callweave.operators.vectors import top_neighbours

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return top_neighbours(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 3)


# ---- evaluation --------------------------------------------------------------------------------------------------------

_PAIRS = "WITH " + HOPS + """, g AS (SELECT turn_id, call_id, start_s, end_s, state FROM gold_turns WHERE end_s > start_s AND call_id IS NOT NULL),
pairs AS (SELECT h.row_id, h.call_id, h.t_s, h.state, h.confidence, arg_min(g.state, g.turn_id) FILTER (g.state IS NOT NULL) AS gold_state FROM hops h LEFT JOIN g ON h.call_id = g.call_id AND greatest(h.t_s - 0.25, 0) >= g.start_s AND greatest(h.t_s - 0.25, 0) < g.end_s GROUP BY ALL)
"""


def _pairs(spark, d):
    g = gold(spark, d).filter("state IS NOT NULL").select("call_id", "turn_id", "start_s", "end_s", "state")
    return metrics.gold_at(hops(spark, d).select("row_id", "call_id", "t_s", "state", "confidence"), g)


@query(_PAIRS + "SELECT row_id, gold_state FROM pairs")
def gold_alignment(spark, d):
    return _pairs(spark, d).select("row_id", "gold_state")


@query(_PAIRS + "SELECT gold_state, count(*) FILTER (state = 'ivr') AS pred_ivr, count(*) FILTER (state = 'human') AS pred_human, count(*) FILTER (state = 'hold') AS pred_hold, count(*) FILTER (state = 'other') AS pred_other FROM pairs WHERE gold_state IN ('ivr', 'human', 'hold', 'other') GROUP BY 1")
def confusion_matrix(spark, d):
    return metrics.confusion(_pairs(spark, d), "gold_state", "state")


@query(_PAIRS.rstrip() + """, k AS (SELECT gold_state AS g, state AS p FROM pairs WHERE gold_state IN ('ivr', 'human', 'hold', 'other') AND state IN ('ivr', 'human', 'hold', 'other')), s AS (SELECT unnest(['ivr', 'human', 'hold', 'other']) AS state),
m AS (SELECT state, (SELECT count(*) FROM k WHERE g = state) AS support, (SELECT count(*) FROM k WHERE p = state) AS claimed, (SELECT count(*) FROM k WHERE g = state AND p = state) AS tp FROM s),
r AS (SELECT *, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM m WHERE support + claimed > 0), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r)
SELECT state, round(pr, 4) AS precision, round(re, 4) AS recall, round(f1, 4) AS f1, support, CAST(NULL AS DOUBLE) AS accuracy FROM f UNION ALL SELECT 'all', NULL, NULL, round(avg(f1) FILTER (support > 0), 4), CAST(sum(support) AS BIGINT), round(sum(tp) / sum(support), 4) FROM f""")
def state_metrics(spark, d):
    return metrics.state_metrics(_pairs(spark, d), "gold_state", "state")


@query(_RUNS + "SELECT call_id, t_s AS t, state AS kind FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY t_s, row_id) AS z FROM r) WHERE st = 1 AND z > 1")
def change_points(spark, d):
    return metrics.change_points(hops(spark, d), "call_id", "t_s", "state", "row_id")


@query()
def boundary_recall(spark, d):
    g = metrics.change_points(gold(spark, d).filter("state IS NOT NULL"), "call_id", "start_s", "state", "turn_id").withColumn("tag", F.lit(None).cast("string"))
    p = metrics.change_points(hops(spark, d), "call_id", "t_s", "state", "row_id").withColumn("tag", F.lit(None).cast("string"))
    return metrics.boundary_recall(g, p, "call_id", (0.5, 1.0, 2.0))


@query()
def event_match(spark, d):
    e = table(spark, d, "call_events").filter("call_id IS NOT NULL AND t_s IS NOT NULL").select("call_id", F.col("t_s").alias("t"), F.col("event_type").alias("kind"), F.element_at("meta", "outcome").alias("tag")).dropDuplicates(["call_id", "t", "kind"])
    ours = transfer_fsm(spark, d).select("call_id", F.col("t_s").alias("t"), F.col("event_type").alias("kind"), F.col("outcome").alias("tag"))
    return metrics.match_counts(metrics.match_events(e, ours, "call_id", 8.0))


_STAB = """p AS (SELECT call_id, count(*) AS c FROM (SELECT call_id, state, lag(state) OVER (PARTITION BY call_id ORDER BY t_s, row_id) AS b FROM hops) WHERE b <> state GROUP BY 1), q AS (SELECT call_id, count(*) AS c FROM (SELECT call_id, state, lag(state) OVER (PARTITION BY call_id ORDER BY start_s, turn_id) AS b FROM g WHERE state IS NOT NULL) WHERE b <> state GROUP BY 1)"""


@query(_PAIRS.rstrip() + f""", {_STAB} SELECT h.call_id, coalesce(p.c, 0) AS changes, round(coalesce(p.c, 0) / greatest(h.dur / 3600, 1e-9), 1) AS per_hour, coalesce(q.c, 0) AS gold_changes, greatest(0, coalesce(p.c, 0) - coalesce(q.c, 0)) AS excess FROM (SELECT call_id, max(t_s) - min(t_s) AS dur FROM hops GROUP BY 1) h LEFT JOIN p USING (call_id) LEFT JOIN q USING (call_id)""")
def stability(spark, d):
    return metrics.stability(hops(spark, d), gold(spark, d).filter("state IS NOT NULL"))


@query("SELECT sub_label, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, max(latency_ms) AS max_ms, round(avg(CASE WHEN latency_ms > 15 THEN 1.0 ELSE 0.0 END), 6) AS over_budget, round(avg(latency_ms) / 15.0, 6) AS rtf FROM timeline WHERE latency_ms IS NOT NULL GROUP BY 1")
def latency_percentiles(spark, d):
    return metrics.latency(table(spark, d, "timeline").select("sub_label", "latency_ms"), "latency_ms", 15.0, ["sub_label"])


@query("""SELECT call_id, max(latency_ms) FILTER (k = round_even(0.95 * (n - 1), 0)) AS nearest_rank, max(latency_ms) FILTER (k = n // 2) AS upper_median FROM (SELECT call_id, latency_ms, row_number() OVER (PARTITION BY call_id ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY call_id) AS n FROM timeline WHERE latency_ms IS NOT NULL) GROUP BY 1""")
def latency_nearest_rank(spark, d):
    return metrics.nearest_rank(table(spark, d, "timeline").select("call_id", "latency_ms"), "latency_ms", 0.95, ["call_id"])


@query(_PAIRS.rstrip() + """, c AS (SELECT confidence, CASE WHEN state = gold_state THEN 1.0 ELSE 0.0 END AS ok, CASE WHEN confidence < 0 THEN NULL WHEN confidence < 0.4 THEN 0.0 WHEN confidence < 0.6 THEN 0.4 WHEN confidence < 0.8 THEN 0.6 WHEN confidence < 0.9 THEN 0.8 WHEN confidence < 1.01 THEN 0.9 END AS lo FROM pairs WHERE gold_state IS NOT NULL AND confidence IS NOT NULL),
b AS (SELECT lo, count(*) AS n, avg(confidence) AS conf, avg(ok) AS acc, sum((confidence - ok) ** 2) AS sq FROM c WHERE lo IS NOT NULL GROUP BY 1)
SELECT CAST(lo AS DOUBLE) AS lo, n, round(conf, 6) AS mean_confidence, round(acc, 6) AS accuracy, round(conf - acc, 6) AS gap, round(sum(sq) OVER () / sum(n) OVER (), 6) AS brier, round(sum(abs(conf - acc) * n) OVER () / sum(n) OVER (), 6) AS ece FROM b""")
def calibration(spark, d):
    p = _pairs(spark, d).filter("gold_state IS NOT NULL")
    return metrics.calibration(p, "confidence", F.col("state") == F.col("gold_state"))


@query("SELECT CASE WHEN final_label IS NULL THEN 'no coverage' WHEN final_label IN ('survey', 'unknown') THEN 'unscorable: ' || final_label WHEN CAST(agreement AS DOUBLE) < 0.6 - 1e-9 THEN 'below agreement' ELSE 'scored' END AS reason, count(*) AS n FROM clips WHERE agreement IS NULL OR NOT isnan(agreement) GROUP BY 1")
def exclusion_ledger(spark, d):
    return metrics.exclusions(table(spark, d, "clips").filter("agreement IS NULL OR NOT isnan(agreement)").select("final_label", F.col("agreement").cast("double").alias("agreement")), "final_label", "agreement", 0.6)


@query(_PAIRS + "SELECT row_id, round(avg(CASE WHEN state = gold_state THEN 1.0 WHEN gold_state IS NOT NULL THEN 0.0 END) OVER (PARTITION BY call_id ORDER BY t_s, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_accuracy FROM pairs")
def running_accuracy(spark, d):
    return metrics.running_accuracy(_pairs(spark, d), "call_id", ["t_s", "row_id"], F.col("state") == F.col("gold_state")).select("row_id", "running_accuracy")


@query(_MODAL.rstrip() + """, dur AS (SELECT call_id, count(*) AS n_segments, round(coalesce(sum(end_s - start_s) FILTER (state = 'ivr'), 0), 3) AS ivr_s, round(coalesce(sum(end_s - start_s) FILTER (state = 'human'), 0), 3) AS human_s, round(coalesce(sum(end_s - start_s) FILTER (state = 'hold'), 0), 3) AS hold_s, round(coalesce(sum(end_s - start_s) FILTER (state = 'other'), 0), 3) AS other_s FROM segs GROUP BY 1),
h AS (SELECT call_id, count(*) AS n_hops, round(max(t_s), 3) AS last_s, count(DISTINCT speaker_id) AS n_speakers, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms, count(*) FILTER (latency_ms > 500) AS over_budget_hops FROM hops GROUP BY 1)
SELECT call_id, n_hops, last_s, n_speakers, p95_latency_ms, over_budget_hops, n_segments, ivr_s, human_s, hold_s, other_s, CASE greatest(ivr_s, human_s, hold_s, other_s) WHEN ivr_s THEN 'ivr' WHEN human_s THEN 'human' WHEN hold_s THEN 'hold' ELSE 'other' END AS dominant, p95_latency_ms < 500 AS realtime_ok FROM h LEFT JOIN dur USING (call_id)""")
def call_summary(spark, d):
    h = hops(spark, d)
    return metrics.call_summary(timeseries.segment_timeline(h, labels=False), h)


@query(_PAIRS + "SELECT gold_state, call_id, CAST(grouping(call_id) AS INTEGER) AS pooled, count(*) AS n, count(*) FILTER (state = gold_state) AS hit FROM pairs WHERE gold_state IS NOT NULL GROUP BY GROUPING SETS ((gold_state), (call_id), ())")
def corpus_pool(spark, d):
    p = _pairs(spark, d).filter("gold_state IS NOT NULL")
    g = p.groupingSets([[F.col("gold_state")], [F.col("call_id")], []], F.col("gold_state"), F.col("call_id"))
    return g.agg(F.grouping("call_id").cast("int").alias("pooled"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == F.col("gold_state")).alias("hit"))


@query("""WITH g AS (SELECT turn_id, call_id, start_s, end_s, state FROM gold_turns WHERE end_s > start_s AND call_id IS NOT NULL AND state IS NOT NULL), n AS (SELECT call_id, CAST(floor(max(end_s) / 0.5) AS BIGINT) AS n FROM g GROUP BY 1), f AS (SELECT call_id, i * 0.5 + 0.25 AS mid FROM n, unnest(range(0, n)) t(i))
SELECT f.call_id, f.mid, arg_min(g.state, g.turn_id) AS state FROM f JOIN g ON f.call_id = g.call_id AND f.mid >= g.start_s AND f.mid < g.end_s GROUP BY 1, 2""")
def gold_frames(spark, d):
    g = gold(spark, d).filter("state IS NOT NULL").select("call_id", "turn_id", "start_s", "end_s", "state")
    n = g.groupBy("call_id").agg(F.floor(F.max("end_s") / 0.5).alias("n")).filter("n > 0")
    f = n.select("call_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("call_id", (F.col("i") * 0.5 + 0.25).alias("mid"))
    return intervals.interval_join(f, g, ["call_id"], "mid", "start_s", "end_s").groupBy("call_id", "mid").agg(F.min_by("state", "turn_id").alias("state"))


# ---- exports, joins and signals ----------------------------------------------------------------------------------------


@query("""SELECT call_id, event_id, event_type AS type, round(t_s, 3) AS t, round(confidence, 3) AS confidence, event_type IN ('transfer_start', 'transfer_end') AS lifecycle, map_extract_value(meta, 'outcome') AS outcome, map_extract_value(meta, 'prev') AS previous FROM call_events""")
def spec_events(spark, d):
    from callweave.sinks.writers import spec_events as view

    return view(table(spark, d, "call_events"))


@query(_MODAL + """SELECT call_id, round(start_s, 3) AS start, round(end_s, 3) AS "end", state AS label, sub_label, speaker_id AS human_id, mean_confidence AS confidence FROM segs LEFT JOIN subs USING (call_id, run)""")
def spec_segments(spark, d):
    from callweave.sinks.writers import spec_segments as view

    return view(timeseries.segment_timeline(hops(spark, d)))


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def semi_anti_join(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").join(o.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").join(o.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query()
def synthetic_corpus(spark, d):
    """Made-up calls of all scenarios with their gold (no input table)."""
    from callweave.sources import synth

    c = synth.corpus(spark, 1)
    return c.select("call_id", "scenario", "seed", F.round("duration_s", 3).alias("duration_s"), F.size("turns").alias("turns"), F.size("events").alias("events"), F.length("wav").alias("bytes"))


@query()
def acoustic_features(spark, d):
    """Acoustic scores of the windows of made-up calls: WAV bytes are decoded and measured in one Arrow pass."""
    from callweave.operators.acoustics import window_features
    from callweave.sources import synth

    return window_features(synth.corpus(spark, 3).select("call_id", "wav"), hop_s=0.5)


# ---- whole calls -------------------------------------------------------------------------------------------------------


_TRACKED: dict[tuple, tuple] = {}


def _tracked(spark, timed: bool = False):
    """Made-up calls of all scenarios, tracked from their sound, script and carrier log: (tracked, gold turns, gold events, calls). Written once a session, for several queries read them."""
    from callweave.operators import engine
    from callweave.sources import synth

    key = (spark.sparkContext.applicationId, timed)
    if key in _TRACKED:
        return _TRACKED[key]
    calls = cut(synth.corpus(spark, 3))
    turns = calls.select("call_id", F.posexplode("turns").alias("turn_id", "x")).select("call_id", "turn_id", "x.*")
    events = calls.select("call_id", F.explode("events").alias("x")).select("call_id", F.col("x.t_s").alias("t"), F.col("x.type").alias("kind"), F.col("x.outcome").alias("tag"))
    carrier = calls.select("call_id", F.explode("telephony").alias("x")).select("call_id", "x.t_s", "x.kind")
    tracked = engine.track_calls(calls.select("call_id", "wav"), turns.filter("text IS NOT NULL").select("call_id", "start_s", "end_s", "text"), carrier, timed=timed)
    _TRACKED[key] = tracked, turns, events, calls
    return _TRACKED[key]


@query()
def track_hops(spark, d):
    """One row per hop of every call: state, probabilities, speaker, text, sub-label, evidence (no input table)."""
    return _tracked(spark)[0].hops.drop("latency_ms", "row_id")


@query()
def track_events(spark, d):
    return _tracked(spark)[0].events


@query()
def track_segments(spark, d):
    return _tracked(spark)[0].segments.drop("best_row")


@query()
def track_report(spark, d):
    """Pooled evaluation of the tracked calls against their gold; times are left out, for they differ from run to run."""
    from callweave.operators import engine

    tracked, turns, events, _ = _tracked(spark)
    return engine.report(tracked, turns, events).filter("section != 'latency'")


@query()
def trained_head(spark, d):
    """A head trained on the tracked calls' scalars, by call, with temperature: accuracy, macro F1 and calibration of both parts."""
    from callweave.operators import engine

    tracked, turns, _, calls = _tracked(spark)
    return engine.train_head(tracked.observations, turns, calls.select("call_id", "scenario"))[1]
