"""Batch and streaming sinks: JSON lines per call, spec view, Parquet datasets, WAV bytes, human-readable lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_results(path: str, **tables: DataFrame) -> None:
    """One folder of JSON lines per table, partitioned by call."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("call_id").json(f"{path}/{name}")


def write_dataset(clips: DataFrame, path: str) -> None:
    """A published dataset: Parquet, partitioned by split where there is one."""
    writer = clips.write.mode("overwrite")
    (writer.partitionBy("split_tag") if "split_tag" in clips.columns else writer).parquet(path)


def write_gold_and_queue(routed: DataFrame, path: str) -> None:
    """Gold and review queue from one evaluation of the routed segments."""
    routed.persist()
    try:
        routed.drop("needs_review").write.mode("overwrite").json(f"{path}/gold")
        routed.filter("needs_review").write.mode("overwrite").json(f"{path}/review_queue")
    finally:
        routed.unpersist()


def spec_segments(segments: DataFrame) -> DataFrame:
    """Segments under the exported names, with times to three decimals."""
    return segments.select("call_id", F.round("start_s", 3).alias("start"), F.round("end_s", 3).alias("end"), F.col("state").alias("label"), "sub_label", F.col("speaker_id").alias("human_id"), F.col("mean_confidence").alias("confidence"))


def spec_events(events: DataFrame) -> DataFrame:
    """Events with a flag for transfer lifecycle and the known keys of meta as columns."""
    meta = lambda k: F.element_at("meta", k)
    return events.select("call_id", "event_id", F.col("event_type").alias("type"), F.round("t_s", 3).alias("t"), F.round("confidence", 3).alias("confidence"), F.col("event_type").isin("transfer_start", "transfer_end").alias("lifecycle"), meta("outcome").alias("outcome"), meta("prev").alias("previous"))


def segment_line(start: Column, end: Column, state: Column, sub: Column, who: Column) -> Column:
    """'  12.50-  20.00  hold/music  human_1'"""
    return F.concat(F.format_string("%8.2f-%8.2f  ", start, end), F.concat_ws("/", state, sub), F.coalesce(F.concat(F.lit("  "), who), F.lit("")))


@dataclass
class Shown:
    """What a live view showed last."""

    t: float | None = None
    state: str | None = None
    wall: float | None = None

    def worth(self, t: float, state: str, gold: str | None, wall: float, print_gap_s: float = 10.0, wall_s: float = 8.0) -> bool:
        """Whether a hop is worth showing: the first, a new state, a wrong one, print_gap_s of audio or wall_s of time since the last shown."""
        wrong = gold is not None and gold == gold and gold != state
        show = self.t is None or state != self.state or wrong or t - self.t >= print_gap_s or wall - self.wall >= wall_s
        self.state = state
        if show:
            self.t, self.wall = t, wall
        return show


def stream_to_files(rows: DataFrame, path: str, checkpoint: str, kind: str = "json") -> StreamingQuery:
    """Exactly-once files of all available input."""
    return rows.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_each(rows: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """on_batch per micro-batch: the place for callbacks per hop."""
    return rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
