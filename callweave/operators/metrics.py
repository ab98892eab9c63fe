"""Evaluation of predicted timelines and events against gold: alignment, confusion, boundaries, events, stability, latency, calibration.

Where there is nothing to score a metric is NULL, not perfect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.operators import ordered
from callweave.operators.intervals import interval_join
from callweave.operators.sequence import greedy_pairs, ordered_fold

STATES = ("ivr", "human", "hold", "other")


def gold_at(hops: DataFrame, gold: DataFrame, offset_s: float = 0.25, default: str | None = None) -> DataFrame:
    """hops (call_id, row_id, t_s, ...) with gold_state: the first gold turn that holds offset_s before the hop, not before 0."""
    asked = hops.withColumn("_at", F.greatest(F.col("t_s") - offset_s, F.lit(0.0)))
    hit = interval_join(asked.select("call_id", "row_id", "_at"), gold.select("call_id", "turn_id", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.col("state").alias("_g")), ["call_id"], "_at", "_s", "_e")
    first = hit.groupBy("row_id").agg(F.min_by("_g", "turn_id").alias("gold_state"))
    out = hops.join(first, "row_id", "left")
    return out.withColumn("gold_state", F.coalesce("gold_state", F.lit(default))) if default else out


def confusion(pairs: DataFrame, gold: str, predicted: str, states: Sequence[str] = STATES) -> DataFrame:
    """Counts of gold against predicted states; other labels are left out."""
    known = pairs.filter(F.col(gold).isin(*states) & F.col(predicted).isin(*states))
    return known.groupBy(F.col(gold).alias("gold_state")).agg(*[F.count_if(F.col(predicted) == s).alias(f"pred_{s}") for s in states])


def state_metrics(pairs: DataFrame, gold: str, predicted: str, states: Sequence[str] = STATES) -> DataFrame:
    """Per state precision, recall, F1 and support (undefined ones 0), and a row 'all' with accuracy and macro F1 over states with support. One pass over the pairs."""
    known = pairs.filter(F.col(gold).isin(*states) & F.col(predicted).isin(*states))
    cells = known.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("g").alias("state"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("state"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("bigint").alias("tp")))).alias("x")).select("x.*")
    per = sides.groupBy("state").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("tp").alias("tp"))
    zero = F.lit(0.0)
    p, r = F.when(F.col("claimed") > 0, F.col("tp") / F.col("claimed")).otherwise(zero), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(zero)
    per = per.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(zero))
    rows = per.select("state", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support", F.lit(None).cast("double").alias("accuracy"))
    total = per.agg(F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 4).alias("f1"), F.sum("support").alias("support"))
    return rows.unionByName(total.select(F.lit("all").alias("state"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), "f1", "support", "accuracy"))


def change_points(hops: DataFrame, key: str, time: str, state: str, tie: str) -> DataFrame:
    """(key, t, state) where the state differs from the row before."""
    return ordered.before(hops, [key], [time, tie], {"_p": F.col(state)}).filter(F.col("_p") != F.col(state)).select(key, F.col(time).alias("t"), F.col(state).alias("kind"))


def match_events(gold: DataFrame, predicted: DataFrame, key: str, tolerance: float | Column) -> DataFrame:
    """(key, kind, gold_t, pred_t, gold_tag, pred_tag): greedy one-to-one pairs, unmatched ones with NULL on the other side. gold, predicted: (key, t, kind, tag).

    Rows further apart than the tolerance never meet, so a key is cut at every gap larger than it and each piece is
    matched by itself.
    """
    within = (tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))).alias("tol")
    both = gold.select(key, "t", "kind", "tag", F.lit(0).alias("side"), within).unionByName(predicted.select(key, "t", "kind", "tag", F.lit(1).alias("side"), within)).filter(F.col("t").isNotNull() & F.col(key).isNotNull())
    order = ["t", "side", "kind", "tag"]
    cut = ordered.before(both, [key], order, {"_before": F.col("t")})
    cut = cut.withColumn("_first", F.when(F.col("_before").isNull() | (F.col("t") - F.col("_before") > F.col("tol")), F.col("t")))
    cut = ordered.before(cut, [key], order, {"_open": F.col("_first")})
    keyed = cut.withColumn("piece", F.concat_ws("\u0001", F.col(key), F.coalesce("_first", "_open").cast("string")))

    def step(state: list, row: list) -> list:
        state.append(row)
        return []

    def finish(state: list) -> list[tuple]:
        g = [(r[0], r[1], r[2]) for r in state if r[3] == 0]
        p = [(r[0], r[1], r[2]) for r in state if r[3] == 1]
        pairs = greedy_pairs([x[:2] for x in g], [x[:2] for x in p], state[0][4])
        out = [(g[i][1], g[i][0], p[j][0], g[i][2], p[j][2]) for i, j, _ in pairs]
        a, b = {i for i, _, _ in pairs}, {j for _, j, _ in pairs}
        return out + [(x[1], x[0], None, x[2], None) for i, x in enumerate(g) if i not in a] + [(x[1], None, x[0], None, x[2]) for j, x in enumerate(p) if j not in b]

    got = ordered_fold(keyed, "piece", ["t", "side", "kind", "tag"], ["t", "kind", "tag", "side", "tol"], list, step, finish, "piece string, kind string, gold_t double, pred_t double, gold_tag string, pred_tag string")
    return got.select(F.split("piece", "\u0001")[0].alias(key), "kind", "gold_t", "pred_t", "gold_tag", "pred_tag")


def boundary_recall(gold: DataFrame, predicted: DataFrame, key: str, tolerances: Sequence[float]) -> DataFrame:
    """Per tolerance the gold change points, how many were found, their share and the lag. The inputs are evaluated once: every tolerance matches its own copy of the rows, told apart by the key."""
    copies = F.explode(F.array(*map(F.lit, map(float, tolerances)))).alias("_tol")
    spread = lambda df: df.select(F.concat_ws("\u0002", copies_name, F.col(key)).alias("_key"), "t", "kind", "tag", "_tol")
    copies_name = F.col("_tol").cast("string")
    g, p = (spread(df.select(key, "t", "kind", "tag", copies)) for df in (gold, predicted))
    pairs = match_events(g, p, "_key", F.col("_tol")).filter("gold_t IS NOT NULL").withColumn("tolerance_s", F.split("_key", "\u0002")[0].cast("double"))
    found = pairs.groupBy("tolerance_s").agg(F.count(F.lit(1)).alias("gold"), F.count("pred_t").alias("found"), F.round(F.avg(F.col("pred_t") - F.col("gold_t")), 4).alias("lag_mean"))
    lags = ordered.percentiles(pairs.withColumn("_lag", F.col("pred_t") - F.col("gold_t")), ["tolerance_s"], "_lag", {"lag_p95": 0.95}).select("tolerance_s", F.round("lag_p95", 4).alias("lag_p95"))
    got = found.join(lags, "tolerance_s", "left")
    return got.select("tolerance_s", "gold", "found", F.round(F.col("found") / F.col("gold"), 4).alias("recall"), "lag_mean", "lag_p95")


def match_counts(pairs: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 and the share of equal tags among pairs whose gold has one; NULL where there is nothing to score."""
    hit = F.col("gold_t").isNotNull() & F.col("pred_t").isNotNull()
    got = pairs.groupBy(*by).agg(F.count_if(hit).alias("tp"), F.count_if(F.col("gold_t").isNull()).alias("fp"), F.count_if(F.col("pred_t").isNull()).alias("fn"), F.count_if(hit & F.col("gold_tag").isNotNull()).alias("tagged"), F.count_if(hit & (F.col("gold_tag") == F.col("pred_tag"))).alias("tag_ok"))
    div = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    return got.select(*by, "tp", "fp", "fn", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), div(F.col("tag_ok"), F.col("tagged")).alias("outcome_accuracy"))


def stability(hops: DataFrame, gold: DataFrame, key: str = "call_id") -> DataFrame:
    """Per call: changes, changes per hour (one decimal), gold changes and the excess."""
    p = change_points(hops, key, "t_s", "state", "row_id").groupBy(key).agg(F.count(F.lit(1)).alias("changes"))
    g = change_points(gold, key, "start_s", "state", "turn_id").groupBy(key).agg(F.count(F.lit(1)).alias("gold_changes"))
    span = hops.groupBy(key).agg((F.max("t_s") - F.min("t_s")).alias("dur"))
    both = span.join(p, key, "left").join(g, key, "left").fillna(0, ["changes", "gold_changes"])
    return both.select(key, "changes", F.round(F.col("changes") / F.greatest(F.col("dur") / 3600, F.lit(1e-9)), 1).alias("per_hour"), "gold_changes", F.greatest(F.lit(0), F.col("changes") - F.col("gold_changes")).alias("excess"))


def latency(rows: DataFrame, column: str, budget: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean, exact percentiles with linear interpolation, maximum, share over budget (strict) and real-time factor."""
    if not by:
        return latency(rows.withColumn("_all", F.lit(1)), column, budget, ["_all"]).drop("_all")
    got = rows.filter(F.col(column).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(column), 6).alias("mean_ms"), F.max(column).alias("max_ms"), F.round(F.avg((F.col(column) > budget).cast("double")), 6).alias("over_budget"), F.round(F.avg(column) / budget, 6).alias("rtf"),
    )
    ps = ordered.percentiles(rows, by, column, {"p50_ms": 0.5, "p95_ms": 0.95}).select(*[F.col(c).alias(f"_{c}") for c in by], *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms")])
    return got.join(ps, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).select(*by, "n", "mean_ms", "p50_ms", "p95_ms", "max_ms", "over_budget", "rtf")


def nearest_rank(rows: DataFrame, column: str, q: float, by: Sequence[str]) -> DataFrame:
    """The value at rank round(q * (n - 1)), half to even, and the upper median, per group."""
    return ordered.ranked_values(rows, by, column, {"nearest_rank": F.bround(F.lit(q) * (F.col("_n") - 1), 0), "upper_median": F.floor(F.col("_n") / 2)}).drop("_n")


BINS = (0.0, 0.4, 0.6, 0.8, 0.9, 1.01)


def calibration(rows: DataFrame, confidence: str, right: Column) -> DataFrame:
    """Per bin [lo, hi): n, mean confidence, accuracy, gap; Brier score and expected calibration error over all on every row."""
    c = F.col(confidence)
    lo = F.lit(None).cast("double")
    for a, b in zip(BINS, BINS[1:]):
        lo = F.when((c >= a) & (c < b), F.lit(a)).otherwise(lo)
    ok = right.cast("double")
    bins = rows.filter(c.isNotNull()).withColumns({"lo": lo, "_ok": ok}).filter("lo IS NOT NULL").groupBy("lo").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg("_ok").alias("acc"), F.sum((c - F.col("_ok")) ** 2).alias("sq"))
    all_ = W.partitionBy(F.lit(0))  # at most one row per bin
    return bins.select("lo", "n", F.round("conf", 6).alias("mean_confidence"), F.round("acc", 6).alias("accuracy"), F.round(F.col("conf") - F.col("acc"), 6).alias("gap"), F.round(F.sum("sq").over(all_) / F.sum("n").over(all_), 6).alias("brier"), F.round(F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("n")).over(all_) / F.sum("n").over(all_), 6).alias("ece"))


def exclusions(rows: DataFrame, gold: str, agreement: str, least: float, unscorable: Sequence[str] = ("survey", "unknown")) -> DataFrame:
    """Why rows are not scored, in the order of the tests."""
    reason = F.when(F.col(gold).isNull(), "no coverage").when(F.col(gold).isin(*unscorable), F.concat(F.lit("unscorable: "), F.col(gold))).when(F.col(agreement) < least - 1e-9, "below agreement").otherwise("scored")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def running_accuracy(rows: DataFrame, key: str, order: Sequence[str], right: Column) -> DataFrame:
    """rows with the accuracy so far within the key; rows without gold don't count."""
    got = ordered.sums_so_far(rows, [key], order, {"_right": right.cast("int"), "_judged": right.isNotNull().cast("int")})
    return got.withColumn("running_accuracy", F.round(F.col("_right") / F.nullif(F.col("_judged"), F.lit(0)), 6)).drop("_right", "_judged", "_bin")


def call_summary(segments: DataFrame, hops: DataFrame, budget_ms: float = 500.0) -> DataFrame:
    """One row per call: duration, segments, dominant state (state order on ties), seconds per state, speakers, latency."""
    width = F.col("end_s") - F.col("start_s")
    dur = segments.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_segments"), *[F.round(F.coalesce(F.sum(F.when(F.col("state") == s, width)), F.lit(0.0)), 3).alias(f"{s}_s") for s in STATES])
    top = F.greatest(*[F.col(f"{s}_s") for s in STATES])
    dominant = F.lit("other")
    for s in reversed(STATES):
        dominant = F.when(F.col(f"{s}_s") == top, s).otherwise(dominant)
    h = hops.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_hops"), F.round(F.max("t_s"), 3).alias("last_s"), F.count_if(F.col("latency_ms") > budget_ms).alias("over_budget_hops"))
    # speakers are counted from one row each; F.count_distinct would do the same after a second shuffle of all hops' groups
    who = hops.filter("speaker_id IS NOT NULL").groupBy("call_id", "speaker_id").agg(F.lit(1).alias("one")).groupBy("call_id").agg(F.sum("one").alias("n_speakers"))
    p95 = ordered.percentiles(hops, ["call_id"], "latency_ms", {"p95": 0.95}).select("call_id", F.round("p95", 6).alias("p95_latency_ms"))
    got = h.join(who, "call_id", "left").join(p95, "call_id", "left").join(dur, "call_id", "left").withColumn("n_speakers", F.coalesce("n_speakers", F.lit(0)))
    return got.withColumn("dominant", dominant).withColumn("realtime_ok", F.col("p95_latency_ms") < budget_ms)
