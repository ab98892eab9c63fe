"""Voting of several labelers over time: on a grid and on the common refinement of all boundaries.

A labeler that says nothing about a stretch abstains (NULL); 'unknown' is a label, and what a stretch gets that nobody
covers. Of a labeler's overlapping segments the first in its list holds at a point, on the grid the last. Ties go to
the most trusted labeler among the winners, else to the first label in order, and are flagged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.functions.numbers import rounded
from callweave.operators import ordered
from callweave.operators.intervals import interval_join
from callweave.operators.sequence import ordered_fold

#: Labelers whose vote breaks ties, most trusted first (fixed value).
TIEBREAK = ("asr_llm", "gpt_audio", "gemini")
#: Grid cells that are voted on together (a minute of cells of 250 ms).
GRID_BLOCK = 240


def _winner(votes: DataFrame, keys: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """votes: keys, labeler, label (NULL labels abstain) to keys, label, agreement, n_voters, tie."""
    cast = votes.filter(F.col("label").isNotNull())
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, tiebreak)), F.col("labeler")), F.lit(0)), F.lit(1 << 30))
    counted = cast.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("rank"))
    best = counted.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("n"), F.col("rank"), F.col("label"))).alias("label"), F.max("n").alias("top"), F.sum("n").alias("n_voters"), F.collect_list("n").alias("_ns"))
    return best.select(*keys, "label", (F.col("top") / F.col("n_voters")).alias("agreement"), "n_voters", (F.size(F.filter("_ns", lambda x: x == F.col("top"))) > 1).alias("tie"))


def grid_vote(segments: DataFrame, calls: DataFrame, cell_s: float = 0.25, tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """(call_id, frame, label, agreement, n_voters): majority per grid cell; a segment covers every cell it touches, later segments of a labeler overwrite earlier ones.

    Cells between two neighbouring boundaries of any segment have the same votes, so votes are counted once per such
    stretch, within blocks of the grid; stretches become cells at the end. Any number of labels and labelers.
    """
    per, keys = GRID_BLOCK, ["call_id", "block"]
    n = F.ceil(F.col("duration_s") / cell_s).cast("int")
    lo, hi = F.greatest(F.lit(0), F.floor(F.col("start") / cell_s)).cast("int"), F.least(n, F.ceil(F.col("end") / cell_s).cast("int"))
    block_of = lambda c: F.floor(c / per).cast("int")
    pieces = segments.withColumns({"lo": lo, "hi": hi}).filter("hi > lo").select("call_id", "labeler", "label", "seq", "lo", "hi", F.explode(F.sequence(block_of(F.col("lo")), block_of(F.col("hi") - 1))).alias("block"))
    pieces = pieces.withColumns({"lo": F.greatest("lo", F.col("block") * per), "hi": F.least("hi", (F.col("block") + 1) * per)})
    whole = calls.filter("duration_s > 0").select("call_id", n.alias("n"), F.explode(F.sequence(F.lit(0), block_of(n - 1))).alias("block")).select(*keys, F.explode(F.array(F.col("block") * per, F.least("n", (F.col("block") + 1) * per))).alias("at"))
    edges = pieces.select(*keys, F.explode(F.array("lo", "hi")).alias("at")).unionByName(whole).distinct()
    stretches = edges.withColumn("until", F.lead("at").over(W.partitionBy(*keys).orderBy("at"))).filter("until IS NOT NULL")
    held = stretches.join(pieces, keys).filter("at >= lo AND at < hi").groupBy(*keys, "at", "labeler").agg(F.max_by("label", "seq").alias("label"))
    voted = stretches.join(_winner(held, [*keys, "at"], tiebreak), [*keys, "at"], "left")
    return voted.select("call_id", F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("frame"), F.coalesce("label", F.lit("unknown")).alias("label"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"), F.coalesce("n_voters", F.lit(0)).alias("n_voters"))


def collapse_grid(frames: DataFrame, cell_s: float = 0.25) -> DataFrame:
    """Runs of equal labels on the grid: start, end, mean agreement (two decimals), least voters."""
    runs = ordered.runs(frames, ["call_id"], ["frame"], F.col("label"), ordered.BIN_COUNT)
    return runs.groupBy("call_id", "_run").agg(F.min("label").alias("label"), (F.min("frame") * cell_s).alias("start"), ((F.max("frame") + 1) * cell_s).alias("end"), rounded(F.avg("agreement"), 2).alias("agreement"), F.min("n_voters").alias("min_voters")).drop("_run")


def refinement_cuts(segments: DataFrame, calls: DataFrame, least_s: float = 0.05) -> DataFrame:
    """(call_id, k, cut, duration_s): all boundaries within 0..duration with both ends; a boundary closer than least_s to the last kept one is left out; the last cut is the duration. Distinct boundaries stream through a fold of constant memory."""
    ends = segments.select("call_id", "duration_s", F.explode(F.array("start", "end")).alias("b")).filter("b >= 0 AND b <= duration_s")
    both = calls.select("call_id", "duration_s", F.explode(F.array(F.lit(0.0), "duration_s")).alias("b"))
    bounds = ends.unionByName(both.select(*ends.columns)).groupBy("call_id", "b").agg(F.max("duration_s").alias("duration_s"))

    # the last kept cut waits: at the end it gives way to the duration
    def step(s: dict, row: list) -> list[tuple]:
        b, s["d"] = row
        if "last" not in s:
            s.update(k=0, last=b)
        elif b - s["last"] >= least_s:
            s["k"], held, s["last"] = s["k"] + 1, s["last"], b
            return [(s["k"] - 1, held, s["d"])]
        return []

    def finish(s: dict) -> list[tuple]:
        return [(s["k"], s["d"] if s["last"] < s["d"] else s["last"], s["d"])]

    return ordered_fold(bounds, "call_id", ["b"], ["b", "duration_s"], dict, step, finish, "call_id string, k int, cut double, duration_s double")


def refined_votes(segments: DataFrame, calls: DataFrame, least_s: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Intervals between cuts (call_id, k, start, end, mid), and per interval and labeler the label, speaker and confidence of its first segment at the middle."""
    cuts = ordered.before(refinement_cuts(segments, calls, least_s), ["call_id"], ["k"], {"start": F.col("cut")}, ordered.BIN_COUNT)
    spans = cuts.filter("k > 0").select("call_id", (F.col("k") - 1).alias("k"), "start", F.col("cut").alias("end"))
    spans = spans.withColumn("mid", (F.col("start") + F.col("end")) / 2)
    at = interval_join(spans, segments.select("call_id", "labeler", "seq", F.col("start").alias("s"), F.col("end").alias("e"), "label", "human_id", "confidence"), ["call_id"], "mid", "s", "e")
    first = at.groupBy("call_id", "k", "labeler").agg(F.min_by(F.struct("label", "human_id", "confidence"), "seq").alias("v"))
    return spans, first.select("call_id", "k", "labeler", "v.*")


def vote_intervals(segments: DataFrame, calls: DataFrame, least_s: float = 0.05, tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """(call_id, k, start, end, label, agreement, n_voters, tie, votes, speakers, confidences) per refined interval."""
    return tally(*refined_votes(segments, calls, least_s), tiebreak)


def tally(spans: DataFrame, votes: DataFrame, tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """vote_intervals from intervals and votes that are there already. An interval has one vote a labeler, so its votes are one small array: counted and looked up in place, after one shuffle."""
    one = votes.groupBy("call_id", "k").agg(F.array_sort(F.collect_list(F.struct("labeler", "label", "human_id", F.round("confidence", 2).alias("confidence")))).alias("v"))
    cast = F.filter("v", lambda x: x["label"].isNotNull())
    labels = F.array_distinct(F.transform("cast", lambda x: x["label"]))
    trust = F.array(*map(F.lit, tiebreak))
    rank = lambda x: F.coalesce(F.nullif(F.array_position(trust, x["labeler"]), F.lit(0)), F.lit(1 << 30))
    counted = F.transform(labels, lambda y: F.struct((-F.size(F.filter("cast", lambda x: x["label"] == y))).alias("n"), F.array_min(F.transform(F.filter("cast", lambda x: x["label"] == y), rank)).alias("rank"), y.alias("label")))
    won = one.withColumn("cast", cast).withColumn("counted", F.array_sort(counted)).withColumn("best", F.get("counted", F.lit(0)))
    table = lambda c: F.map_from_entries(F.transform(F.filter("v", lambda x: x[c].isNotNull()), lambda x: F.struct(x["labeler"], x[c])))
    won = won.select(
        "call_id", "k", F.col("best.label").alias("label"), (-F.col("best.n") / F.size("cast")).alias("agreement"), F.when(F.size("cast") > 0, F.size("cast")).cast("bigint").alias("n_voters"),
        (F.size(F.filter("counted", lambda x: x["n"] == F.col("best.n"))) > 1).alias("tie"), table("label").alias("votes"), table("human_id").alias("speakers"), table("confidence").alias("confidences"),
    )
    out = spans.join(won, ["call_id", "k"], "left")
    return out.select("call_id", "k", "start", "end", F.coalesce("label", F.lit("unknown")).alias("label"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"), F.coalesce("n_voters", F.lit(0)).alias("n_voters"), F.coalesce("tie", F.lit(False)).alias("tie"), "votes", "speakers", "confidences")


def trusted_speaker(intervals: DataFrame, tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """intervals of tally() with the speaker that the most trusted labeler names as human_id: what there is before speakers are resolved."""
    ids = F.map_entries("speakers")
    order = F.transform(ids, lambda x: F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, tiebreak)), x["key"]), F.lit(0)), F.lit(1 << 30)).alias("rank"), x["key"].alias("labeler"), x["value"].alias("who")))
    return intervals.withColumns({"human_id": F.array_min(order)["who"], "speaker_change_votes": F.lit(None).cast("string")})


def informative_labelers(votes: DataFrame) -> DataFrame:
    """(call_id, labeler) of labelers that name more than one speaker in a call."""
    return votes.filter("human_id IS NOT NULL").groupBy("call_id", "labeler").agg(F.count_distinct("human_id").alias("n_ids")).filter("n_ids > 1")


def name_speakers(rows: list[tuple[int, str, dict[str, str]]]) -> dict[int, tuple[str, str | None]]:
    """Common speaker names of human intervals in order: rows are (k, label, informative labelers' own ids).

    A labeler's own name for a person keeps the common name it was first seen with; known names vote, unknown ones make
    a new person, an interval without any name keeps the person before. The second value says how many of the labelers
    present before and now changed their own id, where the common name changed.
    """
    common: dict[tuple[str, str], str] = {}
    people, before, before_name = 0, {}, None
    out: dict[int, tuple[str, str | None]] = {}
    for k, label, ids in rows:
        if label != "human":
            continue
        known: dict[str, int] = {}
        for pair in ids.items():
            if pair in common:
                known[common[pair]] = known.get(common[pair], 0) + 1
        if known:
            name = max(known, key=known.get)
        elif ids:
            people += 1
            name = f"human_{people}"
        else:
            people = max(people, 1)
            name = before_name or f"human_{people}"
        for pair in ids.items():
            common.setdefault(pair, name)
        both = [x for x in ids if x in before]
        changed = f"{sum(ids[x] != before[x] for x in both)}/{len(both)}" if before_name is not None and name != before_name and both else None
        out[k] = (name, changed)
        before, before_name = ids, name
    return out


def assign_speakers(intervals: DataFrame, votes: DataFrame) -> DataFrame:
    """intervals with human_id and speaker_change_votes; a call's intervals are few (its boundaries), so a call is one group."""
    useful = votes.join(informative_labelers(votes).select("call_id", "labeler"), ["call_id", "labeler"], "left_semi").filter("human_id IS NOT NULL")
    ids = useful.groupBy("call_id", "k").agg(F.array_sort(F.collect_list(F.struct("labeler", "human_id"))).alias("ids"))
    rows = intervals.join(ids, ["call_id", "k"], "left").select("call_id", "k", "label", "ids")

    def step(seen: list, row: list) -> list:
        k, label, own = row
        seen.append((int(k), label, {x["labeler"]: x["human_id"] for x in own} if own is not None else {}))
        return []

    def finish(seen: list) -> list[tuple]:
        return [(k, *v) for k, v in name_speakers(seen).items()]

    named = ordered_fold(rows, "call_id", ["k"], ["k", "label", "ids"], list, step, finish, "call_id string, k int, human_id string, speaker_change_votes string")
    return intervals.join(named, ["call_id", "k"], "left")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Neighbours with the same label and speaker (NULL equals NULL) become one: agreement weighted by duration (three decimals), least voters, any tie, votes of the first widest piece."""
    runs = ordered.runs(intervals, ["call_id"], ["k"], F.struct("label", "human_id"), ordered.BIN_COUNT)
    width = F.col("end") - F.col("start")
    return runs.groupBy("call_id", "_run").agg(
        F.min("label").alias("label"), F.min("human_id").alias("human_id"), rounded(F.min("start"), 2).alias("start"), rounded(F.max("end"), 2).alias("end"),
        rounded(F.sum(F.col("agreement") * width) / F.sum(width), 3).alias("agreement"), F.min("n_voters").alias("min_voters"), F.bool_or("tie").alias("has_tie"),
        F.min_by("speaker_change_votes", "k").alias("speaker_change_votes"), F.max_by("speakers", F.struct(width, -F.col("k"))).alias("speakers"),
    ).drop("_run")


def review_route(segments: DataFrame, rate: float = 0.12, partial_rate: float = 0.30) -> DataFrame:
    """segments with reason and needs_review: ties and splits always, full agreement at rate, a majority at partial_rate; sampled by a hash of call and start, so that a rerun asks for the same."""
    n = F.col("min_voters")
    reason = F.when(F.col("has_tie"), "mandatory_tie").when(F.col("agreement") >= 0.999, "spot_check_full").when((n > 0) & (F.col("agreement") >= 2 / F.greatest(n, F.lit(1)) - 1e-6), "spot_check_majority").otherwise("mandatory_split")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "call_id", F.format_string("%.2f", "start"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return segments.withColumn("reason", reason).withColumn("needs_review", F.when(F.col("reason").startswith("mandatory"), True).when(F.col("reason") == "spot_check_full", draw < rate).otherwise(draw < partial_rate))
