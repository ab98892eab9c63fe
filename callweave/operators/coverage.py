"""Overlapping and gapped intervals per entity: continuous periods and the gaps between them.

Each entity has an ordered map of disjoint intervals. An insertion finds the intervals it overlaps by binary search,
replaces them by their union and so moves the gaps. The map is associative (a map can be inserted into another), so
every input partition first folds its own rows and only disjoint intervals are shuffled: an entity that holds a third
of all rows arrives as a few intervals per input partition.

Bounds are seconds as doubles and are kept as whole microseconds. Rows with a null, NaN or infinite bound, or that do
not end after they start, are left out. A null entity counts as missing and is left out. An entity without a known
extent is cut at 0 only and has no last gap. Empty input gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import shuffle_partitions


US = 1_000_000


class IntervalMap:
    """Ordered disjoint closed intervals of whole numbers; intervals at most join_within apart become one."""

    __slots__ = ("starts", "ends", "join_within")

    def __init__(self, join_within: int = 0):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.join_within = join_within

    def insert(self, start: int, end: int) -> None:
        """Add [start, end], merging what it overlaps, touches or comes within join_within of."""
        i = bisect_left(self.ends, start - self.join_within)
        j = bisect_right(self.starts, end + self.join_within)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j] = [start]
        self.ends[i:j] = [end]

    def periods(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends)

    def gaps(self, start: int, end: int | None) -> Iterator[tuple[int, int]]:
        """Uncovered stretches from start to end (open at the end where end is None)."""
        at = start
        for a, b in self.periods():
            if a > at:
                yield at, a
            at = max(at, b)
        if end is not None and end > at:
            yield at, end


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    maps: dict[str, IntervalMap] = {}
    held = 0

    def flush() -> pd.DataFrame:
        out = [(k, a, b) for k, m in maps.items() for a, b in m.periods()]
        maps.clear()
        return pd.DataFrame(out, columns=["entity", "a", "b"])

    for batch in batches:
        for k, a, b in zip(batch["entity"], batch["a"].tolist(), batch["b"].tolist()):
            m = maps.get(k)
            if m is None:
                m = maps[k] = IntervalMap()
            m.insert(a, b)
        held += len(batch)
        if held > 2_000_000:  # bounds the worker's memory; the maps are merged again after the shuffle
            yield flush()
            held = 0
    yield flush()


def _pieces(within: int, least_gap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # every row of an entity is in this partition; an entity is complete when the next one begins
        entity, rows, extent, out = None, [], None, []

        def close() -> None:
            periods = IntervalMap(join_within=within - 1)
            for a, b in rows:
                a, b = max(a, 0), b if extent is None else min(b, extent)
                if b > a:
                    periods.insert(a, b)
            if periods.starts:
                out.extend((entity, "period", a, b) for a, b in periods.periods())
                out.extend((entity, "gap", a, b) for a, b in periods.gaps(0, extent) if b - a >= least_gap)

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=["entity", "piece", "a", "b"])
            out.clear()
            return frame

        for batch in batches:
            for k, a, b, e in zip(batch["entity"], batch["a"].tolist(), batch["b"].tolist(), batch["extent"].tolist()):
                if k != entity:
                    if entity is not None:
                        close()
                    entity, rows, extent = k, [], None
                if a == a:  # not missing
                    rows.append((int(a), int(b)))
                if e == e:
                    extent = int(e)
            yield flush()
        if entity is not None:
            close()
        yield flush()

    return run


def interval_coverage(intervals: DataFrame, extents: DataFrame, entity: str, start: str, end: str, extent_entity: str, extent: str, within_s: float = 0.05) -> DataFrame:
    """(entity, piece, start_ms, end_ms): periods and gaps of every entity that has a usable interval.

    Intervals less than within_s apart make one period; gaps are within_s or longer. An entity whose intervals are all
    outside its extent has no usable one and is left out.
    """
    us = lambda c: F.round(F.col(c) * US, 0).cast("bigint")
    inf = F.lit(float("inf"))
    usable = intervals.filter(F.col(entity).isNotNull() & (F.col(end) > F.col(start)) & ~F.isnan(start) & ~F.isnan(end) & (F.abs(start) < inf) & (F.abs(end) < inf))
    folded = usable.select(F.col(entity).alias("entity"), us(start).alias("a"), us(end).alias("b")).mapInPandas(_fold, "entity string, a bigint, b bigint")
    ends = extents.filter(F.col(extent_entity).isNotNull() & (F.col(extent) >= 0) & ~F.isnan(extent) & (F.abs(extent) < inf)).select(F.col(extent_entity).alias("entity"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), us(extent).alias("extent"))
    both = folded.withColumn("extent", F.lit(None).cast("bigint")).unionByName(ends)
    pieces = both.repartition(shuffle_partitions(intervals.sparkSession), "entity").sortWithinPartitions("entity").mapInPandas(_pieces(round(within_s * US), round(within_s * US)), "entity string, piece string, a bigint, b bigint")
    ms = lambda c: F.round(F.col(c) / 1_000, 0).cast("bigint")
    return pieces.select(F.col("entity").alias(entity), "piece", ms("a").alias("start_ms"), ms("b").alias("end_ms"))
