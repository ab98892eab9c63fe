"""Matching records of two tables by nearest time within a tolerance.

Method: x-fast tries. Per entity, hash tables hold the bit prefixes of all timestamps, one table per prefix length.
The longest stored prefix of a query time is found by binary search over the prefix lengths; its node's smallest and
largest leaf give predecessor and successor, and the nearer one within the tolerance is taken.

Distribution: time is cut into blocks that are much longer than the tolerance; the key of a task is a hash of
(entity, block), so an entity that holds a third of all rows is spread over its blocks. Candidates within the tolerance
of a block's border are also sent to the neighbouring block, which keeps the result exact. Candidates with equal entity
and time are reduced to the smallest id before the shuffle.

Nulls and ties: rows without entity or time (null, NaN, infinite) match nothing. Entities are equal if they differ only
in case or outer blanks. Distances are compared in whole microseconds; of equally near candidates the smallest id is
taken. Repeated candidate rows change nothing; every query row is answered by itself. Empty inputs give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.hashing import HashTable

US = 1_000_000
#: Rows of both sides that a group holds on average, at most.
GROUP_ROWS = 100_000


class XFastTrie:
    """Predecessor and successor among the times of several entities; times are whole numbers in [0, 2**bits)."""

    def __init__(self, entity: np.ndarray, time: np.ndarray, bits: int):
        """entity: small dense numbers; (entity, time) pairs are distinct and sorted."""
        self.bits = bits
        self.leaves = (entity.astype(np.uint64) << np.uint64(bits)) | time.astype(np.uint64)
        self.levels: list[HashTable] = []
        self._low: list[np.ndarray] = []
        self._high: list[np.ndarray] = []
        for level in range(bits + 1):  # level: number of trailing bits cut off; level == bits is the entity's root
            prefix = self.leaves >> np.uint64(level)
            first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(prefix) else np.array([], np.int64)
            self.levels.append(HashTable(prefix[first], np.arange(len(first))))
            self._low.append(first)
            self._high.append(np.r_[first[1:], len(prefix)][: len(first)] - 1)

    def neighbours(self, entity: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the last leaf <= time and of the first leaf >= time of the same entity, -1 where there is none."""
        key = (entity.astype(np.uint64) << np.uint64(self.bits)) | time.astype(np.uint64)
        n = len(key)
        pred, succ = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        low, high = np.zeros(n, np.int64), np.full(n, self.bits, np.int64)
        node = np.full(n, -1, np.int64)
        rooted = self.levels[self.bits].get(key >> np.uint64(self.bits))
        live = rooted >= 0
        node[live] = rooted[live]
        # smallest level whose prefix is stored; high always is for live queries
        while True:
            open_ = live & (low < high)
            if not open_.any():
                break
            mid = (low + high) // 2
            for level in np.unique(mid[open_]):
                at = np.flatnonzero(open_ & (mid == level))
                got = self.levels[level].get(key[at] >> np.uint64(level))
                hit = got >= 0
                high[at[hit]], node[at[hit]] = level, got[hit]
                low[at[~hit]] = level + 1
        for level in np.unique(high[live]) if live.any() else []:
            at = np.flatnonzero(live & (high == level))
            first, last = self._low[level][node[at]], self._high[level][node[at]]
            if level == 0:
                pred[at], succ[at] = first, first
                continue
            right = ((key[at] >> np.uint64(level - 1)) & np.uint64(1)).astype(bool)  # the child the query would take is missing
            pred[at] = np.where(right, last, first - 1)
            succ[at] = np.where(right, last + 1, first)
        own = lambda i: (i >= 0) & (i < len(self.leaves)) & (self.leaves[np.clip(i, 0, max(0, len(self.leaves) - 1))] >> np.uint64(self.bits) == entity.astype(np.uint64)) if len(self.leaves) else np.zeros(n, bool)
        return np.where(own(pred), pred, -1), np.where(own(succ), succ, -1)


def _match(tolerance: int, bits: int, columns: list[str]):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "match_id": pd.Series(dtype="int64"), "diff_us": pd.Series(dtype="int64")})[columns]
        # one dense number per (entity, block); times are relative to the block's start less the tolerance
        both = pd.concat([candidates[["entity", "block"]], queries[["entity", "block"]]])
        code = both.groupby(["entity", "block"], sort=False).ngroup().to_numpy()
        ec, eq = code[: len(candidates)], code[len(candidates) :]
        tc, tq, ids = candidates["rel"].to_numpy(), queries["rel"].to_numpy(), candidates["match_id"].to_numpy()
        order = np.lexsort((ids, tc, ec))
        ec, tc, ids = ec[order], tc[order], ids[order]
        keep = np.r_[True, (ec[1:] != ec[:-1]) | (tc[1:] != tc[:-1])]
        ec, tc, ids = ec[keep], tc[keep], ids[keep]
        pred, succ = XFastTrie(ec, tc, bits).neighbours(eq, tq)
        far = np.int64(1) << 60
        dp = np.where(pred >= 0, tq - tc[pred], far)
        ds = np.where(succ >= 0, tc[succ] - tq, far)
        ip, is_ = ids[pred], ids[succ]
        take_pred = (dp < ds) | ((dp == ds) & (ip <= is_))
        diff, match = np.where(take_pred, dp, ds), np.where(take_pred, ip, is_)
        ok = diff <= tolerance
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[ok], "match_id": match[ok], "diff_us": diff[ok]})[columns]

    return run


def nearest_in_time(queries: DataFrame, candidates: DataFrame, *, query_id: str, candidate_id: str, entity: str, time: str, tolerance_s: float, block_s: float = 600.0, groups: int | None = None) -> DataFrame:
    """(query_id, match_id, diff_us): for every query with a candidate within tolerance_s, the nearest one.

    groups: tasks' keys, over which blocks are spread by hash; by default four per shuffle partition and one per GROUP_ROWS
    rows at least, so that what a task holds does not grow with the data.
    """
    tolerance, block = round(tolerance_s * US), round(block_s * US)
    if block < 2 * tolerance:
        raise ValueError("block_s must be at least twice tolerance_s")
    bits = int(block + 2 * tolerance).bit_length()
    spark = queries.sparkSession
    groups = groups or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), (queries.count() + candidates.count()) // GROUP_ROWS)

    def keyed(df: DataFrame, ident: str) -> DataFrame:
        t = F.col(time)
        return df.filter(F.col(entity).isNotNull() & t.isNotNull() & ~F.isnan(t) & (F.abs(t) < 9e12)).select(F.lower(F.trim(F.col(entity))).alias("entity"), F.round(t * US, 0).cast("bigint").alias("us"), F.col(ident).cast("bigint").alias("id"))

    def spread(df: DataFrame, at: Column, name: str) -> DataFrame:
        rel = F.col("us") - at * block + tolerance
        return df.select("entity", at.alias("block"), rel.alias("rel"), F.col("id").alias(name)).withColumn("g", F.pmod(F.xxhash64("entity", "block"), F.lit(groups)))

    block_of = lambda c: F.floor(c / F.lit(block)).cast("bigint")
    q = spread(keyed(queries, query_id), block_of(F.col("us")), "query_id")
    c = keyed(candidates, candidate_id).groupBy("entity", "us").agg(F.min("id").alias("id"))
    c = c.withColumn("block", F.explode(F.sequence(block_of(F.col("us") - tolerance), block_of(F.col("us") + tolerance))))
    c = spread(c, F.col("block"), "match_id")
    return q.groupBy("g").cogroup(c.groupBy("g")).applyInPandas(_match(tolerance, bits, ["query_id", "match_id", "diff_us"]), "query_id bigint, match_id bigint, diff_us bigint")
