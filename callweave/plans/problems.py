"""Queries of the general problems (units, coverage) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave.operators import coverage, units
from callweave.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.foreign_unit_segments(table(spark, d, "raw_segments"), table(spark, d, "chunks"))


def p3_review(spark: SparkSession, d: str) -> DataFrame:
    return units.units_for_review(table(spark, d, "raw_segments"), table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return coverage.interval_coverage(table(spark, d, "labeler_segments").select("call_id", "seg_start", "seg_end"), table(spark, d, "chunks").select("chunk_id", "duration_s"), "call_id", "seg_start", "seg_end", "chunk_id", "duration_s")


QUERIES = {f.__name__: f for f in (p3_found, p3_review, p7_found)}

_CASES = " ".join(f"WHEN regexp_matches({{0}}, '{pattern}') THEN '{unit}'" for unit, pattern in units.UNIT_PATTERNS)
_UNIT = lambda c: f"(CASE WHEN trim({c}) = '' THEN NULL {_CASES.format(f'lower(trim({c}))')} END)"
_FACTOR = "CASE unit " + " ".join(f"WHEN '{u}' THEN {f}" for u, f in units.MS_PER_UNIT.items()) + " END"
_PART = lambda c, p: f"coalesce(TRY_CAST(nullif(regexp_extract({c}, '{p}', 1), '') AS DOUBLE), 0)"


def _clock_sql(c: str) -> str:
    clock = r"^(?:([0-9]+):)?([0-9]+):([0-9]+(?:\.[0-9]+)?)$"
    at = lambda k: f"coalesce(TRY_CAST(nullif(regexp_extract({c}, '{clock}', {k}), '') AS DOUBLE), 0)"
    num = r"([0-9]+(?:\.[0-9]+)?)\s*"
    return f"""CASE WHEN regexp_matches({c}, '{clock}') THEN {at(1)} * 3600000 + {at(2)} * 60000 + {at(3)} * 1000
      WHEN regexp_matches({c}, '^[0-9.]+\\s*(ms|msec|millis[a-z]*)$') THEN {_PART(c, num)}
      ELSE {_PART(c, num + 'h')} * 3600000 + {_PART(c, num + 'm')} * 60000 + {_PART(c, num + 's')} * 1000 END""".replace("\\\\", "\\")


SQL = {
    "p3_found": rf"""
WITH r AS (SELECT *, {_UNIT('time_unit')} AS row_unit, {_UNIT('raw_response')} AS said FROM raw_segments),
res AS (
  SELECT result_id, max(said) AS said, max(CASE WHEN time_text IS NULL AND row_unit IS NULL AND NOT isnan(seg_end) THEN seg_end END) AS hi, max(duration_s) * 1000 AS ref
  FROM r LEFT JOIN chunks ON call_id = chunk_id GROUP BY result_id),
ruled AS (SELECT result_id, coalesce(said, CASE WHEN hi * 1000 BETWEEN 0.85 * ref AND 1.15 * ref THEN 's' WHEN hi * 60000 BETWEEN 0.85 * ref AND 1.15 * ref THEN 'min' WHEN hi BETWEEN 0.85 * ref AND 1.15 * ref THEN 'ms' ELSE 's' END) AS res_unit FROM res),
texts AS (SELECT result_id, seq, raw_id, string_split_regex(regexp_replace(replace(lower(trim(time_text)), ',', '.'), '^[^0-9p]*', ''), '\s*(-->|\.\.+|[–—]|/|\bto\b|\s-\s)\s*') AS two FROM r WHERE time_text IS NOT NULL),
halves AS (SELECT result_id, seq, raw_id, two[1] AS a, two[2] AS b FROM texts),
rows_ AS (
  SELECT result_id, seq, raw_id, {_clock_sql('a')} AS s, {_clock_sql('b')} AS e FROM halves
  UNION ALL
  SELECT result_id, seq, raw_id, seg_start * ({_FACTOR}), seg_end * ({_FACTOR}) FROM (SELECT r.*, coalesce(row_unit, r.said, res_unit) AS unit FROM r JOIN ruled USING (result_id) WHERE time_text IS NULL) WHERE unit <> 's' AND NOT isnan(seg_start) AND NOT isnan(seg_end) AND seg_start IS NOT NULL AND seg_end IS NOT NULL)
SELECT result_id, seq, CAST(round(arg_min(s, raw_id)) AS BIGINT) AS start_ms, CAST(round(arg_min(e, raw_id)) AS BIGINT) AS end_ms FROM rows_ GROUP BY result_id, seq""",
    "p7_found": """
WITH cut AS (
  SELECT s.call_id, greatest(CAST(round(seg_start * 1000000) AS BIGINT), 0) AS a, least(CAST(round(seg_end * 1000000) AS BIGINT), coalesce(CAST(round(duration_s * 1000000) AS BIGINT), 9000000000000000)) AS b, CAST(round(duration_s * 1000000) AS BIGINT) AS dur
  FROM labeler_segments s LEFT JOIN chunks ON s.call_id = chunk_id
  WHERE s.call_id IS NOT NULL AND seg_end > seg_start AND NOT isnan(seg_start) AND NOT isnan(seg_end)),
kept AS (SELECT * FROM cut WHERE b > a),
reach AS (SELECT *, max(b) OVER (PARTITION BY call_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kept),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR a - before >= 50000 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM reach),
periods AS (SELECT call_id, k, min(a) AS a, max(b) AS b, max(dur) AS dur FROM marked GROUP BY call_id, k),
gaps AS (
  SELECT call_id, coalesce(lag(b) OVER (PARTITION BY call_id ORDER BY a), 0) AS a, a AS b FROM periods
  UNION ALL SELECT call_id, max(b) AS a, max(dur) AS b FROM periods GROUP BY call_id)
SELECT call_id, 'period' AS piece, CAST(round(a / 1000.0) AS BIGINT) AS start_ms, CAST(round(b / 1000.0) AS BIGINT) AS end_ms FROM periods
UNION ALL SELECT call_id, 'gap', CAST(round(a / 1000.0) AS BIGINT), CAST(round(b / 1000.0) AS BIGINT) FROM gaps WHERE b - a >= 50000""",
}
