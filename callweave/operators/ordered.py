"""Ordered rows of a key without one task per key: time is cut into bins, and what a bin needs from earlier ones is carried.

Rows are partitioned by (keys, bin). Within a bin ordinary windows do the work. What comes from before is found on a table
of one row per bin, whose only window runs over the bins of a key (a bin of 600 s holds 1,200 hops of 0.5 s, so that
window sees a thousandth of the rows), and is joined back on (keys, bin), the partitioning the windows have anyway. A key that
holds a third of all rows is therefore spread over its bins.

Rows must have non-null keys and orders. A NaN time is in the bin of 0 and is ordered last there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a bin in seconds of time, and in units of counters (grid cells, interval numbers).
BIN_S, BIN_COUNT = 600.0, 2_048.0


def binned(rows: DataFrame, keys: Sequence[str], time: str, width: float = BIN_S) -> DataFrame:
    """rows partitioned by (keys, _bin), if they aren't yet."""
    return rows if "_bin" in rows.columns else rows.withColumn("_bin", F.floor(F.col(time) / width)).repartition(*keys, "_bin")


def _inside(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys, "_bin").orderBy(*order)


def _earlier(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)


def before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], width: float = BIN_S) -> DataFrame:
    """rows (with _bin) with, per name, the last non-null value of the column in the rows before."""
    own = binned(rows, keys, order[0], width).withColumns({f"_v_{n}": c for n, c in values.items()})
    last = own.groupBy(*keys, "_bin").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n in values])
    carried = last.select(*keys, "_bin", *[F.last(f"_e_{n}", ignorenulls=True).over(_earlier(keys)).alias(f"_e_{n}") for n in values])
    w = _inside(keys, order).rowsBetween(W.unboundedPreceding, -1)
    got = own.join(carried, [*keys, "_bin"]).withColumns({n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(w), F.col(f"_e_{n}")) for n in values})
    return got.drop(*[f"_{x}_{n}" for n in values for x in "ve"])


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, width: float = BIN_S) -> DataFrame:
    """rows (with _bin) with _run, the order columns of the first row of the run of equal values (NULL equals NULL) that the row is in."""
    own = binned(rows, keys, order[0], width).withColumn("_value", F.struct(value.alias("v")))
    w, at = _inside(keys, order), F.struct(*order)
    # NULL for the first row of a bin: whether it starts a run depends on the bin before
    own = own.withColumn("_change", F.when(~F.lag("_value").over(w).eqNullSafe(F.col("_value")) & (F.row_number().over(w) > 1), at))
    bins = own.groupBy(*keys, "_bin").agg(F.min_by("_value", at).alias("_first"), F.max_by("_value", at).alias("_last"), F.min(at).alias("_at"), F.max("_change").alias("_inner"))
    fresh = ~F.lag("_last").over(W.partitionBy(*keys).orderBy("_bin")).eqNullSafe(F.col("_first"))
    bins = bins.withColumn("_start", F.when(fresh, F.col("_at"))).withColumn("_mark", F.coalesce("_inner", "_start"))
    bins = bins.select(*keys, "_bin", F.coalesce("_start", F.last("_mark", ignorenulls=True).over(_earlier(keys))).alias("_open"))
    inner = F.last("_change", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return own.join(bins, [*keys, "_bin"]).withColumn("_run", F.coalesce(inner, F.col("_open"))).drop("_value", "_change", "_open")


def sums_so_far(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], width: float = BIN_S) -> DataFrame:
    """rows (with _bin) with, per name, the sum of the column up to the row; NULL counts as 0."""
    own = binned(rows, keys, order[0], width).withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in values.items()})
    bins = own.groupBy(*keys, "_bin").agg(*[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in values])
    bins = bins.select(*keys, "_bin", *[F.coalesce(F.sum(f"_e_{n}").over(_earlier(keys)), F.lit(0)).alias(f"_e_{n}") for n in values])
    w = _inside(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return own.join(bins, [*keys, "_bin"]).withColumns({n: F.col(f"_e_{n}") + F.sum(f"_v_{n}").over(w) for n in values}).drop(*[f"_{x}_{n}" for n in values for x in "ve"])


def with_last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, width: float = BIN_S) -> DataFrame:
    """rows and, flagged _halo, in every bin copies of the k rows before it: windows of k rows before a row then see all of theirs within the bin."""
    own = binned(rows, keys, order[0], width)
    n = own.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy("_bin")
    n = n.withColumn("_end", F.sum("_n").over(w)).withColumn("_begin", F.col("_end") - F.col("_n"))
    n = n.withColumn("_next", F.collect_list(F.struct("_bin", "_begin")).over(w.rowsBetween(1, k)))
    last = own.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "_bin").orderBy(*[F.desc(c) for c in order]))).filter(F.col("_k") <= k)
    sent = last.join(n.select(*keys, "_bin", "_end", "_next"), [*keys, "_bin"]).withColumn("_to", F.explode("_next")).filter(F.col("_end") - F.col("_k") >= F.col("_to._begin") - k)
    halo = sent.withColumn("_bin", F.col("_to._bin")).select(*own.columns, F.lit(True).alias("_halo"))
    return own.withColumn("_halo", F.lit(False)).unionByName(halo)


def with_recent(rows: DataFrame, keys: Sequence[str], time: str, lookback: float, width: float = BIN_S) -> DataFrame:
    """rows and, flagged _halo, in every bin copies of the rows of the bin before that are less than lookback older than its start."""
    if lookback > width:
        raise ValueError("a lookback may be as long as a bin at most")
    bin_ = F.floor(F.col(time) / width)
    sent = F.floor((F.col(time) + lookback) / width)
    copies = F.when(sent > bin_, F.array(F.struct(bin_.alias("_bin"), F.lit(False).alias("_halo")), F.struct(sent.alias("_bin"), F.lit(True).alias("_halo")))).otherwise(F.array(F.struct(bin_.alias("_bin"), F.lit(False).alias("_halo"))))
    return rows.drop("_bin").withColumn("_c", F.explode(copies)).select(*[c for c in rows.columns if c != "_bin"], "_c._bin", "_c._halo")


def _bucket(value: Column) -> Column:
    """A number that never falls where the value rises: steps of an eighth of a per cent or so of its size."""
    size = F.floor(F.log(F.greatest(F.abs(value), F.lit(1e-12))) * 64) + 2_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("bigint")


def ranked_values(rows: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, _n, names): the exact values at ranks (from 0, expressions of _n, the number of non-null values) per group.

    A histogram of buckets finds where the ranks lie; only the rows of those buckets are ordered, so no task holds a
    group, and equal values are counted before.
    """
    own = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_m")).withColumn("_b", _bucket(F.col("_x")))
    groups = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, k in enumerate(keys)]
    names = [f"_g{i}" for i in range(len(keys))]
    own = own.select(*keys, *groups, "_x", "_m", "_b")
    histogram = own.groupBy(*names, "_b").agg(F.sum("_m").alias("_in"))
    w = W.partitionBy(*names)
    histogram = histogram.withColumn("_n", F.sum("_in").over(w)).withColumn("_upto", F.sum("_in").over(w.orderBy("_b")))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), r.cast("bigint").alias("rank")) for n, r in ranks.items()])
    asked = histogram.withColumn("_w", F.explode(wanted)).filter((F.col("_w.rank") >= F.col("_upto") - F.col("_in")) & (F.col("_w.rank") < F.col("_upto")))
    asked = asked.select(*names, "_b", "_n", F.col("_w.name").alias("_name"), (F.col("_w.rank") - (F.col("_upto") - F.col("_in"))).alias("_rank"))
    inside = own.join(asked.select(*names, "_b").distinct(), [*names, "_b"], "left_semi").withColumn("_c", F.sum("_m").over(W.partitionBy(*names, "_b").orderBy("_x")))
    hit = inside.join(asked, [*names, "_b"]).filter((F.col("_rank") < F.col("_c")) & (F.col("_rank") >= F.col("_c") - F.col("_m")))
    return hit.groupBy(*keys, *names).agg(F.max("_n").alias("_n"), *[F.max(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in ranks]).drop(*names)


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(keys, _n, names): exact percentiles with linear interpolation."""
    at = {n: (F.col("_n") - 1) * q for n, q in qs.items()}
    got = ranked_values(rows, keys, value, {f"_lo_{n}": F.floor(a) for n, a in at.items()} | {f"_hi_{n}": F.ceil(a) for n, a in at.items()})
    between = {n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (a - F.floor(a)) for n, a in at.items()}
    return got.select(*keys, "_n", *[c.alias(n) for n, c in between.items()])
