"""Runs of consecutive equal events in ordered sequences, each collapsed to one row.

Method: associative run summaries. Rows are range-sorted by (entity, time) into chunks; every chunk encodes its runs
locally; the first and last run of a chunk may continue in its neighbours and are joined by a prefix merge. An entity
that holds a third of all rows is cut into many chunks; what is merged afterwards is at most two runs per chunk.

Nulls and ties: rows without entity, time (null, NaN, infinite) or state are left out first. States that differ only in
case, blanks or punctuation are the same; a state without a letter or digit counts as missing. Rows of one entity with
equal time are one event, with the smallest row id; if their states differ, the smallest state in order is taken.
Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.session import cut

SUMMARY = pa.schema([("entity", pa.string()), ("state", pa.string()), *((k, pa.int64()) for k in ("first_us", "last_us", "events", "first_row_id"))])
RUN_SCHEMA = "entity string, state string, first_us bigint, last_us bigint, events bigint, first_row_id bigint, piece bigint"


def encode_runs(entity: np.ndarray, state: np.ndarray, us: np.ndarray, row: np.ndarray, most_gap: int) -> dict[str, np.ndarray]:
    """Run summaries of sorted events; entity and state are codes. An event repeats the time of the one before it in the same entity if it is a copy."""
    n = len(us)
    same = np.zeros(n, bool)
    same[1:] = (entity[1:] == entity[:-1]) & (us[1:] == us[:-1])
    event = np.flatnonzero(~same)
    rows = np.minimum.reduceat(row, event) if n else row
    e, t = entity[event], us[event]
    s = np.minimum.reduceat(state, event) if n else state
    new = np.ones(len(event), bool)
    new[1:] = (e[1:] != e[:-1]) | (s[1:] != s[:-1]) | (t[1:] - t[:-1] > most_gap)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(event)][: len(first)] - 1
    return {"entity": e[first], "state": s[first], "first_us": t[first], "last_us": t[last], "events": last - first + 1, "first_row_id": rows[first]}


def _chunk(most_gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = np.int64(TaskContext.get().partitionId()) << 40
        number, held, done_first = 0, None, False

        def out(frame: dict[str, np.ndarray], names: list, states: list, at: slice, edge: bool) -> pa.RecordBatch:
            nonlocal number
            cut = {k: v[at] for k, v in frame.items()}
            n = len(cut["events"])
            piece = np.full(n, -1, np.int64) if edge else base + number + np.arange(n)
            number += n
            names_, states_ = pa.array(names, pa.string()).take(pa.array(cut["entity"])), pa.array(states, pa.string()).take(pa.array(cut["state"]))
            return pa.RecordBatch.from_arrays([names_, states_, *(pa.array(cut[k].astype(np.int64)) for k in ("first_us", "last_us", "events", "first_row_id")), pa.array(piece)], names=["entity", "state", "first_us", "last_us", "events", "first_row_id", "piece"])

        for batch in batches:
            if not batch.num_rows:
                continue
            us, row = batch.column(2), batch.column(3)
            part = pa.Table.from_arrays([batch.column(0), batch.column(1), us, us, pa.array(np.ones(batch.num_rows, np.int64)), row], schema=SUMMARY)
            if held is not None:
                part = pa.concat_tables([held, part])
            # the last event's run may go on in the next batch: keep its rows' summary as rows
            entity = part.column("entity").combine_chunks().dictionary_encode()
            state = part.column("state").combine_chunks().dictionary_encode()
            names, raw_states = entity.dictionary.to_pylist(), state.dictionary.to_pylist()
            order = np.argsort(np.array(raw_states, object)) if raw_states else np.array([], int)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            states = [raw_states[i] for i in order]
            runs = encode_chunk(entity.indices.to_numpy().astype(np.int64), rank[state.indices.to_numpy()], part, most_gap)
            n = len(runs["events"])
            if n > 1:
                if not done_first:
                    yield out(runs, names, states, slice(0, 1), True)
                    done_first = True
                    start = 1
                else:
                    start = 0
                if n - 1 > start:
                    yield out(runs, names, states, slice(start, n - 1), False)
            held = summary_rows(runs, n - 1, names, states)
        if held is not None:
            names, states = [held.column("entity")[0].as_py()], [held.column("state")[0].as_py()]
            last = {"entity": np.array([0]), "state": np.array([0]), **{k: np.array([held.column(k)[0].as_py()]) for k in ("first_us", "last_us", "events", "first_row_id")}}
            yield out(last, names, states, slice(0, 1), True)

    return run


def encode_chunk(entity: np.ndarray, state: np.ndarray, part: pa.Table, most_gap: int) -> dict[str, np.ndarray]:
    """Runs of a table of summaries (plain events are summaries of one event), in order."""
    first, last, events, row = (part.column(k).to_numpy() for k in ("first_us", "last_us", "events", "first_row_id"))
    if events[0] == 1:  # a carried single event is a plain event
        return encode_runs(entity, state, first, row, most_gap)
    # one carried run stands before plain events; those at its last time are copies of its last event
    copies = 1 + int(np.argmin(np.r_[(entity[1:] == entity[0]) & (first[1:] == last[0]), False]))
    row0 = row[:copies].min() if first[0] == last[0] else row[0]
    carried = {"entity": entity[:1], "state": state[:1], "first_us": first[:1], "last_us": last[:1], "events": events[:1], "first_row_id": np.array([row0])}
    runs = encode_runs(entity[copies:], state[copies:], first[copies:], row[copies:], most_gap)
    if not len(runs["events"]):
        return carried
    if runs["entity"][0] == entity[0] and runs["state"][0] == state[0] and runs["first_us"][0] - last[0] <= most_gap:
        runs["events"][0] += events[0]
        runs["first_us"][0], runs["first_row_id"][0] = first[0], row0
        return runs
    return {k: np.r_[carried[k], runs[k]] for k in runs}


def summary_rows(runs: dict[str, np.ndarray], at: int, names: list, states: list) -> pa.Table:
    """The run at an index as a table of one summary."""
    return pa.table([[names[runs["entity"][at]]], [states[runs["state"][at]]], *([int(runs[k][at])] for k in ("first_us", "last_us", "events", "first_row_id"))], schema=SUMMARY)


def collapse_runs(rows: DataFrame, *, entity: str, time: str, state: str, row_id: str, most_gap_s: float, least_events: int = 1, chunks: int | None = None) -> DataFrame:
    """(entity, state, first_row_id, events, first_us, last_us): the runs of at least least_events events.

    A run ends where, in order of time, the state changes or the next event comes more than most_gap_s later.
    """
    gap = round(most_gap_s * 1_000_000)
    t, s = F.col(time), F.regexp_replace(F.lower(F.col(state)), r"[^\p{L}\p{N}]+", "")
    clean = rows.filter(F.col(entity).isNotNull() & t.isNotNull() & ~F.isnan(t) & (F.abs(t) < 9e12) & (s != "")).select(
        F.col(entity).alias("entity"), s.alias("state"), F.round(t * 1_000_000, 0).cast("bigint").alias("first_us"), F.col(row_id).cast("bigint").alias("first_row_id")
    )
    by = ["entity", "first_us"]
    ordered = (clean.repartitionByRange(chunks, *by) if chunks else clean.repartitionByRange(*by)).sortWithinPartitions(*by, "state")
    # summaries are few beside the rows; they are used twice, so they are written
    local = cut(ordered.mapInArrow(_chunk(gap), RUN_SCHEMA))
    # inner runs of a chunk are done; its first and last run, at most two rows a chunk, are joined with their neighbours
    w = W.partitionBy("entity").orderBy("first_us")
    breaks = (F.lag("state").over(w) != F.col("state")) | (F.col("first_us") - F.lag("last_us").over(w) > gap)
    edges = local.filter("piece < 0").withColumn("starts", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("run", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = edges.groupBy("entity", "run").agg(F.min("state").alias("state"), F.min_by("first_row_id", "first_us").alias("first_row_id"), F.sum("events").alias("events"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    names = ["entity", "state", "first_row_id", "events", "first_us", "last_us"]
    return local.filter("piece >= 0").select(*names).unionByName(joined.select(*names)).filter(F.col("events") >= least_events)
