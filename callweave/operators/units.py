"""Quantities recorded in different units: state, infer and convert the unit of time bounds.

The operator reads the unit stated on a row, else the one stated in the free text of the row's result, else the unit
that a calibrated random forest finds from magnitude, source, category and neighbouring values. A confident answer of
the forest decides: its unit is converted if the result then passes an exact check against a reference extent (here the
chunk's length), else the default unit holds. Answers that are not confident are routed to review; until a reviewer has
looked, the exact check alone speaks for them (the unit that passes it, else the default). A forest that is wrong
therefore changes rows.

Distribution: units and written times are read once per row and written (checkpoint); results are profiled once, by
numbers only, so that both aggregates are hash aggregates with partial sums before the shuffle. Only rows without any
stated unit are joined with what was inferred. A result that holds a third of all rows is a few partial sums.

Nulls: a row without a readable start or end is not converted. NaN and infinite bounds count as missing. Blank unit
texts count as not stated. A result without a call or extent has nothing to check against. Empty input gives an empty
result with the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.session import cut

# Milliseconds in one unit.
MS_PER_UNIT = {"ms": 1.0, "s": 1_000.0, "min": 60_000.0, "h": 3_600_000.0, "frame20": 20.0, "cell250": 250.0, "sample8k": 0.125}

# How a unit is written in a unit column (whole text, lower case) or named in free text; the first that matches holds.
UNIT_PATTERNS = [
    ("cell250", r"250\s*-?ms|grid\s*250|quarter[- ]seconds?|viertelsekunden?|cuartos? de segundo"),
    ("frame20", r"20\s*-?\s*ms|frames?\b"),
    ("sample8k", r"\bsamples?\b|\bsamples?@|8\s*khz|8000"),
    ("ms", r"^ms\.?$|\bms\b|\bmsecs?\b|\bmillis(?:econds?)?\b|millisekunden|milisegundos|millisecondes"),
    ("h", r"^h\.?$|\bhrs?\b|\bhours?\b|\bstunden?\b|\bhoras?\b|\bheures?\b"),
    ("min", r"^m\.?$|\bmins?\b|\bminutes?\b|\bminuten?\b|\bminutos?\b"),
    ("s", r"^s\.?$|\bsecs?\b|\bseconds?\b|\bsekunden?\b|\bsegundos?\b|\bsecondes?\b"),
]
#: Units that may be inferred where none is stated.
INFERRED = ("s", "min", "ms")
FEATURES = ["log_end", "log_ref", "log_ratio", "in_s", "in_min", "in_ms", "whole_share", "log_mean", "log_segments", "source", "category"]
#: Sources and categories are hashed into so many values each.
CATEGORIES = 64
#: The calibration's prior: so many probabilities between none and 1, each worth so many held-out rows.
PRIOR_STEPS, PRIOR_WEIGHT = 60, 1.0
#: Units by number, in the order of MS_PER_UNIT, counted from 1.
UNITS = tuple(MS_PER_UNIT)


def unit_named(text: Column) -> Column:
    """The unit a text names, NULL where it names none (null and blank texts included)."""
    low = F.lower(F.trim(text))
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(UNIT_PATTERNS):
        out = F.when(low.rlike(pattern), F.lit(unit)).otherwise(out)
    return F.when(low.isNotNull() & (low != ""), out)


def unit_number(unit: Column) -> Column:
    """Number of a unit in UNITS, NULL for none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, UNITS)), unit), F.lit(0)).cast("int")


def unit_name(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, UNITS)), number - 1)


def unit_factor(number: Column) -> Column:
    """Milliseconds in one of the unit of that number."""
    return F.get(F.array(*map(F.lit, MS_PER_UNIT.values())), number - 1)


def _number(text: Column, pattern: str) -> Column:
    got = F.regexp_extract(text, pattern, 1)
    return F.when(got != "", got.cast("double"))


def clock_ms(text: Column) -> Column:
    """Milliseconds of one time written as clock, ISO duration, or number with units (comma or point); NULL if it is none of these."""
    t = F.regexp_replace(F.lower(F.trim(text)), ",", ".")
    clock = r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$"
    hours = F.coalesce(_number(t, clock), F.lit(0.0))
    as_clock = hours * 3_600_000 + F.regexp_extract(t, clock, 2).try_cast("double") * 60_000 + F.regexp_extract(t, clock, 3).try_cast("double") * 1_000
    as_ms = _number(t, r"^(\d+(?:\.\d+)?)\s*(?:ms|msecs?|millis\w*)\.?$")
    h, m, s = (_number(t, rf"(\d+(?:\.\d+)?)\s*{u}") for u in ("h", r"m(?!s|illi)", r"s"))
    parts = F.when(F.coalesce(h, m, s).isNotNull(), F.coalesce(h, F.lit(0.0)) * 3_600_000 + F.coalesce(m, F.lit(0.0)) * 60_000 + F.coalesce(s, F.lit(0.0)) * 1_000)
    return F.when(t.rlike(clock), as_clock).when(as_ms.isNotNull(), as_ms).otherwise(parts)


def time_range_ms(text: Column) -> tuple[Column, Column]:
    """Start and end in milliseconds of a written range such as 'from 0:44.1 to 1:02,5'; what stands before the first time is left out."""
    body = F.regexp_replace(F.trim(text), r"(?i)^.*?(?=pt\d|\d)", "")
    two = F.split(body, r"\s*(?:-->|→|\.\.+|[–—]|/|\bto\b|\buntil\b|\s-\s)\s*", 2)
    return clock_ms(F.get(two, F.lit(0))), clock_ms(F.get(two, F.lit(1)))


@dataclass(frozen=True)
class UnitConfig:
    """sample_results bounds the labelled results the forest is fitted on (a hash sample, at most this many); the rest covers all rows."""

    low: float = 0.85
    high: float = 1.15
    confident: float = 0.9
    default: str = "s"
    sample_results: int = 20_000
    trees: int = 16
    depth: int = 5
    seed: int = 7


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def read_rows(segments: DataFrame) -> DataFrame:
    """Every row with what it states, read once and written: written (bounds stand in time_text), a and b (numbers, or ms of written times), row_unit and said (numbers of the units of the row and of its copy of the result's text)."""
    lo, hi = time_range_ms(F.col("time_text"))
    written = F.col("time_text").isNotNull()
    return cut(segments.select(
        F.col("raw_id").cast("bigint").alias("raw_id"), "result_id", "seq", "call_id",
        F.pmod(F.xxhash64("labeler"), F.lit(CATEGORIES)).cast("int").alias("source"), F.pmod(F.xxhash64("label"), F.lit(CATEGORIES)).cast("int").alias("category"),
        written.alias("written"), F.when(written, lo).otherwise(_finite(F.col("seg_start"))).alias("a"), F.when(written, hi).otherwise(_finite(F.col("seg_end"))).alias("b"),
        unit_number(unit_named(F.col("time_unit"))).alias("row_unit"), unit_number(unit_named(F.col("raw_response"))).alias("said"),
    ))


def result_profiles(rows: DataFrame, extents: DataFrame) -> DataFrame:
    """One row per result of read_rows(): the unit its text or its rows state, the magnitudes of its plain numbers and the reference extent in ms.

    extents: (call_id, extent_ms). Of several calls of one result the last in order counts.
    """
    plain = F.when(~F.col("written"), F.col("b"))
    stated = F.when(~F.col("written"), F.col("row_unit"))
    bare = F.when(F.col("row_unit").isNull(), plain)
    # numbers per (result, call) first: the call's name, a string, is then compared on one row a result only
    sums = rows.groupBy("result_id", "call_id").agg(
        F.max("source").alias("source"), F.max("category").alias("category"), F.max("said").alias("said"),
        F.max(stated).alias("hi_unit"), F.min(stated).alias("lo_unit"), F.max(bare).alias("bare_end"), F.max(plain).alias("max_end"),
        F.sum(plain).alias("sum_end"), F.count(plain).alias("n_end"), F.count_if(plain == F.floor(plain)).alias("n_whole"), F.count(F.lit(1)).alias("segments"),
    )
    most = lambda *names: [F.max(n).alias(n) for n in names]
    total = lambda *names: [F.sum(n).alias(n) for n in names]
    profiles = sums.groupBy("result_id").agg(*most("call_id", "source", "category", "said", "hi_unit", "bare_end", "max_end"), F.min("lo_unit").alias("lo_unit"), *total("sum_end", "n_end", "n_whole", "segments"))
    return profiles.join(extents, "call_id", "left")


def _passes(end: str, unit: str, config: UnitConfig) -> Column:
    """The exact check: the largest end, read in the unit, is as long as the extent, within the limits."""
    return (F.col(end) * MS_PER_UNIT[unit]).between(F.col("extent_ms") * config.low, F.col("extent_ms") * config.high)


def _features(profiles: DataFrame, end: str, config: UnitConfig) -> DataFrame:
    log = lambda c: F.log10(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-4)))
    share = F.col("n_whole") / F.nullif(F.col("n_end"), F.lit(0))
    return profiles.withColumns({
        "log_end": log(F.col(end)), "log_ref": log(F.col("extent_ms")), "log_ratio": log(F.col("extent_ms")) - log(F.col(end)), "whole_share": F.coalesce(share, F.lit(0.0)),
        "log_mean": log(F.col("sum_end") / F.nullif(F.col("n_end"), F.lit(0))), "log_segments": log(F.col("segments").cast("double")),
        **{f"in_{u}": F.coalesce(_passes(end, u, config).cast("double"), F.lit(0.0)) for u in INFERRED},
    })


def fit_forest(train: DataFrame, config: UnitConfig):
    """scored(rows) that adds proposed (a unit's name) and confidence; None where the sample states fewer than two units.

    A random forest is fitted on two thirds of the sample; its top probability is calibrated by isotonic regression on
    the other third, together with a weak prior that takes the probability as it is: where the held-out rows say nothing,
    the forest is not believed more than it believes itself.
    """
    if len(train.groupBy("y").count().collect()) < 2:
        return None
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform
    held = F.pmod(F.col("h"), F.lit(3)) == 0
    fit_rows = ready(train).filter(~held)
    if fit_rows.select("y").distinct().count() < 2:
        fit_rows = ready(train)
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=config.trees, maxDepth=config.depth, maxBins=CATEGORIES, minInstancesPerNode=20, featureSubsetStrategy="0.75", seed=config.seed).fit(fit_rows)
    scored = lambda df: forest.transform(ready(df)).withColumn("top", F.array_max(vector_to_array("probability"))).withColumn("proposed", F.get(F.array(*map(F.lit, INFERRED)), F.col("prediction").cast("int")))
    checked = scored(train.filter(held)).select((F.col("prediction") == F.col("y")).cast("double").alias("right"), "top", F.lit(1.0).alias("w"))
    grid = [(right, k / PRIOR_STEPS, PRIOR_WEIGHT * (k / PRIOR_STEPS if right else 1 - k / PRIOR_STEPS)) for k in range(PRIOR_STEPS // len(INFERRED), PRIOR_STEPS + 1) for right in (1.0, 0.0)]
    prior = train.sparkSession.createDataFrame(grid, "right double, top double, w double").filter("w > 0")
    calibrate = IsotonicRegression(featuresCol="top", labelCol="right", weightCol="w", predictionCol="confidence").fit(cut(checked.unionByName(prior)))
    return lambda df: calibrate.transform(scored(df))


def infer_units(profiles: DataFrame, config: UnitConfig = UnitConfig(), fit=fit_forest) -> DataFrame:
    """For results whose unit nothing states: result_id, unit, proposed, confidence, accepted (the forest decided).

    With fewer than two stated units there is nothing to fit and every result goes to review.
    """
    stated_unit = unit_name(F.coalesce("said", F.when(F.col("hi_unit") == F.col("lo_unit"), F.col("hi_unit"))))
    stated = profiles.filter(F.col("max_end").isNotNull() & F.col("extent_ms").isNotNull()).withColumn("y", F.array_position(F.array(*map(F.lit, INFERRED)), stated_unit).cast("double") - 1).filter("y >= 0")
    sample = stated.withColumn("h", F.pmod(F.xxhash64("result_id"), F.lit(1 << 30))).orderBy("h").limit(config.sample_results)
    scored = fit(cut(_features(sample, "max_end", config)), config)

    asked = profiles.filter(F.col("said").isNull() & F.col("bare_end").isNotNull())
    own, any_ = F.lit(False), F.lit(None).cast("string")
    for unit in reversed(INFERRED):
        own = own | ((F.col("proposed") == unit) & _passes("bare_end", unit, config))
        any_ = F.when(_passes("bare_end", unit, config), F.lit(unit)).otherwise(any_)
    if scored is None:
        answered = asked.withColumns({"proposed": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    else:
        answered = scored(_features(asked, "bare_end", config))
    sure = F.coalesce(F.col("confidence") >= config.confident, F.lit(False))
    default = F.lit(config.default)
    return answered.select(
        "result_id",
        F.when(sure, F.when(own, F.col("proposed")).otherwise(default)).otherwise(F.coalesce(any_, default)).alias("unit"),
        "proposed", F.round("confidence", 6).alias("confidence"), (sure & F.coalesce(own, F.lit(False))).alias("accepted"),
    )


def _extents(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("call_id"), (_finite(F.col("duration_s")) * 1_000).alias("extent_ms"))


def common_units(segments: DataFrame, chunks: DataFrame, config: UnitConfig = UnitConfig(), fit=fit_forest) -> DataFrame:
    """Every row of segments that has both bounds, in milliseconds: raw_id, result_id, seq, unit, unit_from, confidence, accepted, start_ms, end_ms.

    unit_from: 'text' (bounds written as text), 'row', 'result', 'inferred'. accepted is false for inferred units that
    need a review. Extra columns of the inputs are ignored.
    """
    rows = read_rows(segments)
    profiles = cut(result_profiles(rows, _extents(chunks)))
    inferred = infer_units(profiles, config, fit).select("result_id", unit_number(F.col("unit")).alias("unit_no"), "confidence", "accepted")
    both = rows.filter("a IS NOT NULL AND b IS NOT NULL").select("raw_id", "result_id", "seq", "written", "a", "b", "row_unit", "said")
    none = {"unit_no": F.lit(None).cast("int"), "confidence": F.lit(None).cast("double"), "accepted": F.lit(None).cast("boolean")}
    stated = "written OR row_unit IS NOT NULL OR said IS NOT NULL"
    # a row's own copy of the result's text may be missing: then the result's other rows say it
    others = profiles.filter("said IS NOT NULL").select("result_id", F.col("said").alias("result_said"))
    open_rows = both.filter(f"NOT ({stated})").drop("said").join(others, "result_id", "left").withColumnRenamed("result_said", "said").join(inferred, "result_id", "left")
    known = both.filter(stated).withColumns(none)
    every = known.unionByName(open_rows.select(known.columns))
    unit = F.coalesce("row_unit", "said", "unit_no", F.lit(UNITS.index(config.default) + 1))
    factor = F.when(F.col("written"), 1.0).otherwise(unit_factor(unit))
    said = F.coalesce("row_unit", "said").isNotNull() | F.col("written")
    return every.select(
        "raw_id", "result_id", "seq", F.when(F.col("written"), "text").otherwise(unit_name(unit)).alias("unit"),
        F.when(F.col("written"), "text").when(F.col("row_unit").isNotNull(), "row").when(F.col("said").isNotNull(), "result").otherwise("inferred").alias("unit_from"),
        F.when(said, F.lit(1.0)).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.when(said, F.lit(True)).otherwise(F.coalesce("accepted", F.lit(False))).alias("accepted"),
        *[F.round(F.col(c) * factor, 0).cast("bigint").alias(n) for c, n in (("a", "start_ms"), ("b", "end_ms"))],
    )


def foreign_unit_segments(segments: DataFrame, chunks: DataFrame, config: UnitConfig = UnitConfig(), fit=fit_forest) -> DataFrame:
    """p3_found: (result_id, seq, start_ms, end_ms) of every segment not recorded as plain numbers of seconds; a segment sent twice counts once (its smallest raw_id)."""
    rows = common_units(segments, chunks, config, fit).filter(F.col("unit") != "s")
    return rows.groupBy("result_id", "seq").agg(F.min_by(F.struct("start_ms", "end_ms"), "raw_id").alias("x")).select("result_id", "seq", "x.start_ms", "x.end_ms")


def units_for_review(segments: DataFrame, chunks: DataFrame, config: UnitConfig = UnitConfig(), fit=fit_forest) -> DataFrame:
    """p3_review: (result_id, unit, proposed, confidence) of inferred units that are uncertain or fail the exact check."""
    return infer_units(cut(result_profiles(read_rows(segments), _extents(chunks))), config, fit).filter(~F.col("accepted")).select("result_id", "unit", "proposed", "confidence")
