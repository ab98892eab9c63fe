"""Interval relations (key, start, end, ...): joins, chunk plans, repair and clipping.

All intervals are half open. Nulls: rows with a null or NaN bound, or that do not end after they start, are no
intervals. Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.numbers import rounded


def usable(segments: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that are intervals."""
    return segments.filter((F.col(end) > F.col(start)) & ~F.isnan(start) & ~F.isnan(end))


def first_copies(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the smallest order: rows sent again are dropped."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str = "start", end: str = "end", bin_width: float = 30.0, how: str = "inner") -> DataFrame:
    """Pairs of a point and an interval of the same keys that contains it.

    Time is cut into bins: an interval goes to every bin it touches, a point to its own, and the join is an equi-join on
    (keys, bin) with a residual filter, so that a key with many rows on both sides is spread over its bins.
    """
    p = points.withColumn("_bin", F.floor(F.col(point) / bin_width))
    i = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(F.col(end) / bin_width))))
    p, i = p.alias("p"), i.alias("i")
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in keys] + [F.col("p._bin") == F.col("i._bin"), F.col(f"p.{point}") >= F.col(f"i.{start}"), F.col(f"p.{point}") < F.col(f"i.{end}")]
    joined = p.join(i, on, how)
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"i.{c}") for c in intervals.columns if c not in (*keys, *points.columns)])


def plan_chunks(recordings: DataFrame, key: str, total: str, chunk_s: float = 300.0, min_tail_s: float = 60.0) -> DataFrame:
    """(key, chunk_index, start_s, end_s): spans of fixed length; a last span shorter than min_tail_s joins the one before."""
    n = F.ceil(F.col(total) / chunk_s)
    tail = F.col(total) - (n - 1) * chunk_s
    kept = F.when((n > 1) & (tail < min_tail_s), n - 1).otherwise(n).cast("int")
    spans = recordings.filter(F.col(total) > 0).withColumn("_n", kept).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    end = F.when(F.col("chunk_index") == F.col("_n") - 1, F.col(total)).otherwise((F.col("chunk_index") + 1) * F.lit(chunk_s))
    return spans.select(key, "chunk_index", (F.col("chunk_index") * F.lit(chunk_s)).alias("start_s"), end.alias("end_s"))


def chunk_metadata(spans: DataFrame, key: str) -> DataFrame:
    """Chunk ids ('first eight characters'_cNN), offsets and durations to three decimals."""
    return spans.select(
        F.format_string("%s_c%02d", F.substring(F.col(key), 1, 8), F.col("chunk_index")).alias("chunk_id"), F.col(key), "chunk_index",
        F.round("start_s", 3).alias("offset_s"), F.round(F.col("end_s") - F.col("start_s"), 3).alias("duration_s"),
    )


def first_chunk_per_call(chunks: DataFrame, call: str) -> DataFrame:
    """The chunk with the smallest index (then id) of every call."""
    rest = [c for c in chunks.columns if c != call]
    return chunks.groupBy(call).agg(F.min_by(F.struct(*rest), F.struct("chunk_index", "chunk_id")).alias("_r")).select(call, "_r.*")


def missing_ids(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Ids that were asked for and are not there."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def unit_scale(segments: DataFrame, keys: Sequence[str], duration: str = "duration_s") -> DataFrame:
    """(keys, n, max_end, duration, scale): 60 where at least three segments end within the first quarter and would end near the duration if their numbers were minutes, else 1."""
    got = segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("max_end"), F.max(duration).alias("dur"))
    minutes = (F.col("n") >= 3) & (F.col("dur") > 0) & (F.col("max_end") > 0) & (F.col("max_end") < 0.25 * F.col("dur")) & (60 * F.col("max_end") <= 1.15 * F.col("dur"))
    return got.withColumn("scale", F.when(minutes, 60.0).otherwise(1.0))


def repair_report(segments: DataFrame, keys: Sequence[str], duration: str = "duration_s") -> DataFrame:
    """Per key: scale, dropped, truncated, spans and coverage before and after scaling and clipping; overlaps count twice in coverage."""
    scales = unit_scale(segments, keys, duration).select(*keys, "scale")
    s = segments.join(scales, list(keys)).withColumns({"s": F.col("start") * F.col("scale"), "e": F.col("end") * F.col("scale")})
    inside = F.col("s") < F.col(duration)
    after = F.least("e", duration)
    kept = inside & (after > F.col("s"))
    # sums of whole milliseconds don't depend on the order of rows
    ms = lambda c: F.floor(c * 1000.0 + 0.5)
    covered = F.coalesce(F.sum(F.when(kept, ms(after - F.col("s")))), F.lit(0))
    return s.groupBy(*keys).agg(
        F.max("scale").alias("unit_scale"),
        F.count_if(~inside).alias("dropped"),
        F.count_if(inside & (F.col("e") > F.col(duration))).alias("truncated"),
        rounded(F.max("end"), 3).alias("span_before_s"),
        rounded(F.coalesce(F.max(F.when(kept, after)), F.lit(0.0)), 3).alias("span_after_s"),
        (F.sum(ms(F.col("end") - F.col("start"))) / 1000.0).alias("coverage_before_s"),
        (covered / 1000.0).alias("coverage_after_s"),
        rounded(covered / 1000.0 / F.max(duration), 3).alias("coverage_fraction"),
    ).withColumn("note", F.concat_ws("; ", F.when(F.col("unit_scale") != 1, F.lit("times were minutes")), F.when(F.col("dropped") > 0, F.format_string("%d dropped", "dropped")), F.when(F.col("truncated") > 0, F.format_string("%d truncated", "truncated"))))


def repaired(segments: DataFrame, keys: Sequence[str], duration: str = "duration_s") -> DataFrame:
    """Segments in seconds, cut to 0..duration."""
    scales = unit_scale(segments, keys, duration).select(*keys, "scale")
    s = segments.join(scales, list(keys)).withColumns({"start": F.col("start") * F.col("scale"), "end": F.least(F.col("end") * F.col("scale"), F.col(duration))})
    return s.filter((F.col("start") < F.col(duration)) & (F.col("end") > F.col("start"))).drop("scale")


def padded_bounds(clips: DataFrame, length: str, pad_s: float) -> DataFrame:
    """Clip bounds widened by pad_s and kept within the recording, in seconds and samples of 8 kHz (truncated)."""
    lo = F.greatest(F.lit(0.0), F.col("start") - pad_s)
    hi = F.least(F.col(length), F.col("end") + pad_s)
    return clips.withColumns({"lo_s": lo, "hi_s": hi, "lo_sample": F.floor(lo * 8000).cast("bigint"), "hi_sample": F.floor(hi * 8000).cast("bigint")})
