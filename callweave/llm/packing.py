"""Filling containers of fixed capacity with items.

Method: first-fit decreasing with a tournament tree over the containers' free space (leftmost container with enough
space in logarithmic time), run independently in randomised groups of items.

Distribution: an item's group is a hash of its key; a group holds about GROUP items, enough to leave little unused
space and few enough for one task. Items larger than the capacity are cut into full pieces, which fill a container
each and need no search, and a rest.

Nulls and ties: items of null or zero size go nowhere. Equal sizes are placed in order of item id and piece. Repeated
item rows are placed as often as they occur. Empty input gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = 20_000


class TournamentTree:
    """Free space of up to n containers, all of one capacity at first."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, n) - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take size from the first container with that much space; its number."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        found = node - self.leaves
        node //= 2
        while node:
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node], node = top, node // 2
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container numbers of items given in decreasing size."""
    tree = TournamentTree(len(sizes), capacity)
    return [tree.first_fit(s) for s in sizes]


def pack(items: DataFrame, item: str, size: str, capacity: int, groups: int | None = None) -> DataFrame:
    """(container, item, piece, size): container is 'group-number'; piece counts from 0 and is 0 for whole items."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    groups = groups or max(1, -(-items.count() // GROUP))
    sized = items.filter(F.col(size) > 0).select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("n"))
    sized = sized.withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    # a repeated item row keeps its own containers through its number among the item's rows
    large = sized.filter(F.col("n") >= capacity).withColumn("copy", F.row_number().over(W.partitionBy("item").orderBy("n")))
    full = large.select("g", "item", "copy", F.explode(F.sequence(F.lit(0), (F.col("n") / capacity).cast("int") - 1)).alias("piece"))
    alone = full.select(F.concat_ws("-", F.lit("full"), "g", "item", "piece", "copy").alias("container"), "item", "piece", F.lit(capacity).cast("bigint").alias("size"))
    rest = sized.select("g", "item", F.floor(F.col("n") / capacity).cast("int").alias("piece"), (F.col("n") % capacity).alias("size")).filter("size > 0")

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "item", "piece"], ascending=[False, True, True], kind="stable")
        bins = first_fit_decreasing(frame["size"].tolist(), capacity)
        return pd.DataFrame({"container": [f"{g}-{b}" for g, b in zip(frame["g"], bins)], "item": frame["item"], "piece": frame["piece"], "size": frame["size"]})

    placed = rest.groupBy("g").applyInPandas(lambda frame: place(frame), "container string, item bigint, piece int, size bigint")
    return placed.unionByName(alone)
