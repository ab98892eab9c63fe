"""Streaming twins of the folds: the same pure step functions inside keyed state, in order of event time.

Rows of a key are held until the watermark passes them, then folded in order; at the end of a call (a timer after its
last row) what is open is closed. A stream and a batch give the same rows, late ones within the watermark included.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callweave.operators import engine as E
from callweave.operators import sequence as S
from callweave.operators.coverage import US, IntervalMap
from callweave.sinks.writers import Shown


def _plain(x):
    """A value as JSON knows it."""
    return x.tolist() if hasattr(x, "tolist") else x


def keyed_fold(rows: DataFrame, key: str, event_time: str, columns: list[str], load: Callable[[str | None], object], save: Callable[[object], str], step: Callable, finish: Callable | None, schema: str, watermark: str = "10 seconds", idle: str = "30 seconds") -> DataFrame:
    """step over the rows of each key in order of event time; finish after idle event time without rows.

    Rows wait in the key's state until the watermark has passed them, so rows that come late, but within the watermark,
    are folded in their place; a timer folds what waits when no further row comes. State is the fold's own and the rows
    of the last watermark delay.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, waiting, last = json.loads(state.get[0]) if state.exists else (None, [], 0)
        fold, out = load(fold), []
        if not state.hasTimedOut:
            for batch in frames:
                at = (batch[event_time].astype("int64") // _PER_MS[batch[event_time].dtype.name.split("[")[1][:2].strip(",]")]).tolist()
                waiting += [[t, [_plain(x) for x in row]] for t, row in zip(at, zip(*(batch[c] for c in columns)))]
            waiting.sort(key=lambda w: (w[0], w[1][0]))
        passed = state.getCurrentWatermarkMs()
        ready = 0
        while ready < len(waiting) and waiting[ready][0] <= passed:
            last = max(last, waiting[ready][0])
            out.extend((k[0], *o) for o in step(fold, waiting[ready][1]))
            ready += 1
        waiting = waiting[ready:]
        if not waiting and last and last + idle_ms <= passed:
            out.extend((k[0], *o) for o in (finish(fold) if finish else []))
            state.remove()
        else:
            state.update((json.dumps([save(fold), waiting, last]),))
            state.setTimeoutTimestamp(max(passed + 1, waiting[0][0] if waiting else last + idle_ms))
        if out:
            yield pd.DataFrame(out, columns=names)

    marked = rows.select(key, event_time, *[c for c in columns if c not in (key, event_time)]).withWatermark(event_time, watermark)
    return marked.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


#: Ticks of a timestamp's unit in a millisecond.
_PER_MS = {"ns": 1_000_000, "us": 1_000, "ms": 1}


def _json_load(kind: type) -> Callable[[str | None], object]:
    return lambda s: kind(**json.loads(s)) if s else kind()


def _json_save(state: object) -> str:
    return json.dumps(state.__dict__)


def stream_transfer_events(hops: DataFrame, event_time: str = "ts") -> DataFrame:
    """Transfer events of a stream of hops (call_id, event_time, columns of sequence.TRANSFER_COLUMNS)."""
    return keyed_fold(hops, "call_id", event_time, S.TRANSFER_COLUMNS, _json_load(S.Transfer), _json_save, S.transfer_row, S.transfer_close, S.TRANSFER_SCHEMA)


def stream_filter(hops: DataFrame, event_time: str = "ts") -> DataFrame:
    """Posterior and committed state of a stream of hops with emissions b0..b3."""

    def step(f: S.Filter, row: list) -> list[tuple]:
        t, r, *b = row
        post, s, p, dwell = S.filter_step(f, t, b)
        return [(t, int(r), *(round(x, 6) for x in post), S.STATES[s], round(p, 6), round(dwell, 3))]

    return keyed_fold(hops, "call_id", event_time, ["t_s", "row_id", "b0", "b1", "b2", "b3"], _json_load(S.Filter), _json_save, step, None, "call_id string, t_s double, row_id bigint, p_ivr double, p_human double, p_hold double, p_other double, state string, confidence double, dwell_s double")


def stream_segments(hops: DataFrame, event_time: str = "ts", hop_s: float = 0.5) -> DataFrame:
    """Closed runs of states (start_s, end_s, state, hops): a run is given out when the next one begins or the call is idle."""

    def step(run: dict, row: list) -> list[tuple]:
        t, state = row
        done = []
        if run.get("state") != state:
            done = finish(run)
            run.clear()
            run.update(state=state, start=t, n=0)
        run["end"], run["n"] = t, run["n"] + 1
        return done

    def finish(run: dict) -> list[tuple]:
        return [(run["start"], round(run["end"] + hop_s, 3), run["state"], run["n"])] if run else []

    return keyed_fold(hops, "call_id", event_time, ["t_s", "state"], lambda s: json.loads(s) if s else {}, json.dumps, step, finish, "call_id string, start_s double, end_s double, state string, hops bigint")


def stream_coverage(intervals: DataFrame, extents: DataFrame, event_time: str = "ts", within_s: float = 0.05) -> DataFrame:
    """(entity, piece, start_ms, end_ms) as interval_coverage() gives them, of a stream of intervals (entity, event_time, start_s, end_s), once an entity is idle: each insertion updates the entity's disjoint-interval map. extents: a table (entity, extent_s)."""
    us = lambda c: F.round(F.col(c) * US, 0).cast("bigint")
    inf, within = F.lit(float("inf")), round(within_s * US)
    usable = intervals.filter((F.col("end_s") > F.col("start_s")) & ~F.isnan("start_s") & ~F.isnan("end_s") & (F.abs("start_s") < inf) & (F.abs("end_s") < inf))
    rows = usable.select("entity", event_time, us("start_s").alias("a"), us("end_s").alias("b")).join(extents.select("entity", us("extent_s").alias("extent")), "entity", "left")

    def load(s: str | None) -> dict:
        periods = IntervalMap(join_within=within - 1)
        extent = None
        if s:
            periods.starts, periods.ends, extent = json.loads(s)
        return {"map": periods, "extent": extent}

    def step(m: dict, row: list) -> list[tuple]:
        a, b, extent = row
        m["extent"] = None if extent is None or extent != extent else int(extent)
        a, b = max(int(a), 0), int(b) if m["extent"] is None else min(int(b), m["extent"])
        if b > a:
            m["map"].insert(a, b)
        return []

    def finish(m: dict) -> list[tuple]:
        periods = list(m["map"].periods())
        gaps = [(a, b) for a, b in m["map"].gaps(0, m["extent"]) if b - a >= within] if periods else []
        ms = lambda x: int(x / 1_000 + 0.5)
        return [(piece, ms(a), ms(b)) for piece, found in (("period", periods), ("gap", gaps)) for a, b in found]

    save = lambda m: json.dumps([m["map"].starts, m["map"].ends, m["extent"]])
    return keyed_fold(rows, "entity", event_time, ["a", "b", "extent"], load, save, step, finish, "entity string, piece string, start_ms bigint, end_ms bigint")


def stream_track(observed: DataFrame, event_time: str = "ts") -> DataFrame:
    """Hops of a stream of observations (columns of engine.TRACK_COLUMNS): speakers, states and transfers, by the step of the batch."""
    return keyed_fold(observed, "call_id", event_time, E.TRACK_COLUMNS, E.Track.loads, E.Track.dumps, E.track_step, E.track_close, E.TRACK_SCHEMA)


def stream_worth_printing(hops: DataFrame, event_time: str = "ts", print_gap_s: float = 10.0, wall_s: float = 8.0) -> DataFrame:
    """Hops (t_s, state, gold) that a live view shows: a new state, a wrong one, print_gap_s of audio or wall_s of time since the last."""
    load = lambda s: Shown(**json.loads(s)) if s else Shown()
    step = lambda shown, row: [tuple(row)] if shown.worth(*row, time.time(), print_gap_s, wall_s) else []
    return keyed_fold(hops, "call_id", event_time, ["t_s", "state", "gold"], load, _json_save, step, None, "call_id string, t_s double, state string, gold string")


def hopping_counts(rows: DataFrame, event_time: str, window: str = "6 seconds", hop: str = "500 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """Counts and mean confidence per call and sliding window."""
    return rows.withWatermark(event_time, watermark).groupBy("call_id", F.window(event_time, window, hop)).agg(F.count(F.lit(1)).alias("hops"), F.avg("confidence").alias("mean_confidence"))


def sessions(rows: DataFrame, event_time: str, key: str, gap: str = "5 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Stretches of a key without a pause of gap or more."""
    return rows.withWatermark(event_time, watermark).groupBy(key, F.session_window(event_time, gap)).agg(F.count(F.lit(1)).alias("n"))


def running_confusion(rows: DataFrame) -> DataFrame:
    """Live confusion counts; write in complete mode."""
    return rows.groupBy("gold_state", "state").agg(F.count(F.lit(1)).alias("n"))
