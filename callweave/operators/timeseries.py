"""Ordered rows per key: as-of lookup, hopping windows, context, runs of states and boundary events.

Everything that looks back works on bins of time (see ordered): no window has a whole key for its partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.operators import ordered
from callweave.session import cut


def state_name(raw: Column) -> Column:
    """A state without case, blanks and punctuation; NULL if nothing is left."""
    s = F.regexp_replace(F.lower(raw), "[^a-z]", "")
    return F.when(s != "", s)


def clean_hops(timeline: DataFrame) -> DataFrame:
    """Hops with a call, a time and a state, one per call and time (the smallest row id), partitioned by call and bin of time (_bin)."""
    rows = timeline.filter("call_id IS NOT NULL AND t_s IS NOT NULL").withColumn("state", state_name(F.col("state"))).filter("state IS NOT NULL")
    rest = [c for c in rows.columns if c not in ("call_id", "t_s")]
    # one shuffle: the groups below and the windows of the operators keep this partitioning
    return ordered.binned(rows, ["call_id"], "t_s").groupBy("call_id", "_bin", "t_s").agg(F.min_by(F.struct(*rest), "row_id").alias("_r")).select("call_id", "t_s", "_bin", "_r.*")


def asof_flags(left: DataFrame, events: DataFrame, key: str, time: str, kinds: dict[str, Sequence[str]], within_s: float = 3.0, cap_s: float = 30.0) -> DataFrame:
    """left with, per name of kinds, the time of the last event of those kinds at or before the row's time, seconds since (capped) and whether within within_s.

    One union, no join of rows: last values over the common order, within bins of time.
    """
    names = list(kinds)
    e = events.select(F.col(key), F.col(time), F.lit(0).alias("_side"), *[F.when(F.col("kind").isin(*kinds[n]), F.col(time)).alias(f"_{n}") for n in names])
    rest = [c for c in left.columns if c not in (key, time, "_bin")]
    both = left.drop("_bin").withColumn("_side", F.lit(1)).unionByName(e, allowMissingColumns=True)
    both = ordered.before(both, [key], [time, "_side"], {f"_l_{n}": F.col(f"_{n}") for n in names}).filter("_side = 1")
    since = {n: F.col(time) - F.col(f"_l_{n}") for n in names}
    return both.select(key, time, *rest, *[F.col(f"_l_{n}").alias(f"last_{n}_s") for n in names], *[F.round(F.least(F.coalesce(since[n], F.lit(cap_s)), F.lit(cap_s)), 6).alias(f"since_{n}_s") for n in names], *[F.coalesce(since[n] <= within_s, F.lit(False)).alias(f"{n}_recent") for n in names])


def hopping_windows(rows: DataFrame, key: str, time: str, window_s: float, hop_s: float, aggregates: dict[str, Column]) -> DataFrame:
    """(key, hop_end, aggregates): windows (hop_end - window_s, hop_end] that end every hop_s; a row is sent to the windows that hold it."""
    first = F.ceil(F.col(time) / hop_s)
    n = int(window_s // hop_s)
    spread = rows.withColumn("_k", F.explode(F.sequence(first, first + n - 1)))
    got = spread.filter(F.col(time) > F.col("_k") * hop_s - window_s).groupBy(key, "_k").agg(*[a.alias(n) for n, a in aggregates.items()])
    return got.select(key, (F.col("_k") * hop_s).alias("hop_end"), *aggregates)


def trailing(rows: DataFrame, key: str, time_ms: str, lookback_s: float, aggregates: dict[str, Column]) -> DataFrame:
    """rows with aggregates over the rows of the last lookback_s up to the row's time (whole ms)."""
    back = int(lookback_s * 1000)
    w = W.partitionBy(key, "_bin").orderBy(time_ms).rangeBetween(-back, 0)
    both = ordered.with_recent(rows, [key], time_ms, back, max(ordered.BIN_S * 1000, back))
    return both.withColumns({n: a.over(w) for n, a in aggregates.items()}).filter("NOT _halo").drop("_bin", "_halo")


def context_delta(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], hops: int = 8) -> DataFrame:
    """Per column: the mean of the last hops rows and the difference to it."""
    w = W.partitionBy(key, "_bin").orderBy(*order).rowsBetween(-(hops - 1), 0)
    both = ordered.with_last_rows(rows, [key], order, hops - 1).withColumns({f"{c}_mean": F.avg(c).over(w) for c in columns})
    return both.filter("NOT _halo").drop("_bin", "_halo").withColumns({f"{c}_delta": F.col(c) - F.col(f"{c}_mean") for c in columns})


def segment_timeline(hops: DataFrame, key: str = "call_id", time: str = "t_s", state: str = "state", tie: str = "row_id", hop_s: float = 0.5, labels: bool = True) -> DataFrame:
    """Runs of states: start, end (the last hop's end), hops, mean confidence, evidence of the surest hop, first speaker and, with labels, the most frequent sub-label (first seen among equals)."""
    used = [c for c in hops.columns if c in (key, time, state, tie, "_bin", "confidence", "speaker_id", "sub_label")]
    rows = ordered.runs(hops.select(*used), [key], [time, tie], F.col(state))
    if labels:
        rows = cut(rows)  # used twice below
    named = F.col("speaker_id").isNotNull()
    got = rows.groupBy(key, "_run").agg(
        F.min(time).alias("start_s"), F.round(F.max(time) + hop_s, 3).alias("end_s"), F.min(state).alias("state"), F.count(F.lit(1)).alias("hops"), F.round(F.avg("confidence"), 3).alias("mean_confidence"),
        F.min_by("speaker_id", F.when(named, F.struct(time, tie))).alias("speaker_id"), F.max_by(tie, F.struct("confidence", -F.col(time))).alias("best_row"),
    )
    if labels:
        counts = rows.filter("sub_label IS NOT NULL").groupBy(key, "_run", "sub_label").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("t0"))
        got = got.join(counts.groupBy(key, "_run").agg(F.max_by("sub_label", F.struct("n", -F.col("t0"))).alias("sub_label")), [key, "_run"], "left")
    return got.drop("_run")


def boundary_events(hops: DataFrame, key: str = "call_id", time: str = "t_s", tie: str = "row_id") -> DataFrame:
    """Events at changes: ivr_exit, human_joined, speaker_changed (against the last known speaker)."""
    prev = ordered.before(hops, [key], [time, tie], {"_ps": F.col("state"), "_pv": F.col("speaker_id")})
    entered = ~F.col("_ps").eqNullSafe(F.col("state"))
    kinds = F.array_compact(F.array(
        F.when(entered & (F.col("_ps") == "ivr"), "ivr_exit"),
        F.when(F.col("speaker_id").isNotNull() & (F.col("speaker_id") != F.col("_pv")), "speaker_changed"),
        F.when(entered & (F.col("state") == "human"), "human_joined"),
    ))
    return prev.select(key, time, F.explode(kinds).alias("event_type"))


def previous_distinct_state(hops: DataFrame, key: str = "call_id", time: str = "t_s", tie: str = "row_id") -> DataFrame:
    """hops with the last state that differs from the row's own: the state before the first hop of its run."""
    changed = ordered.before(hops, [key], [time, tie], {"_ps": F.col("state")})
    first = F.when(F.col("_ps") != F.col("state"), F.col("_ps"))
    got = ordered.before(changed.withColumn("_b", first), [key], [time, tie], {"_earlier": F.col("_b")})
    return got.withColumn("previous_state", F.coalesce("_b", "_earlier")).drop("_ps", "_b", "_earlier", "_bin")


def ring_buffer(rows: DataFrame, key: str, order: Sequence[str], column: str, capacity: int) -> DataFrame:
    """rows with the last capacity values up to the row, oldest first."""
    w = W.partitionBy(key, "_bin").orderBy(*order).rowsBetween(-(capacity - 1), 0)
    return ordered.with_last_rows(rows, [key], order, capacity - 1).withColumn("buffer", F.collect_list(column).over(w)).filter("NOT _halo").drop("_bin", "_halo")
