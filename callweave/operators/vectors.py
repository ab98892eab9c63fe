"""Nearest neighbours of a stated query set by cosine, exact, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4_096


def _matrix(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def top_neighbours(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, blocks: int | None = None) -> DataFrame:
    """(query_id, key, cosine): the k most similar other rows of every query (six decimals, then the smaller key).

    Queries and rows are dealt to blocks; a task multiplies one block of queries with one of rows and keeps its k best
    per query, so that k candidates per query and block of rows are shuffled. Null vectors are left out; a vector of
    length zero has cosine 0 with all.
    """
    clean = lambda df: df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    q, r = clean(queries), clean(rows)
    nq, nr = (blocks, blocks) if blocks else (max(1, -(-q.count() // BLOCK)), max(1, -(-r.count() // BLOCK)))
    qb = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    rb = r.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), key: pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        b = b.sort_values("id")
        ids, m, out = b["id"].to_numpy(), _matrix(b["v"]).T, []
        for at in range(0, len(a), 512):
            part = a.iloc[at : at + 512]
            sims = np.round(_matrix(part["v"]) @ m, 6)
            sims[part["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            flat = np.take_along_axis(sims, order, 1)
            keep = np.isfinite(flat)
            out.append(pd.DataFrame({"query_id": np.repeat(part["id"].to_numpy(), order.shape[1])[keep.ravel()], key: ids[order][keep], "cosine": flat[keep]}))
        return pd.concat(out)

    local = qb.groupBy("qb", "rb").cogroup(rb.groupBy("qb", "rb")).applyInPandas(lambda a, b: best(a, b), f"query_id bigint, {key} bigint, cosine double")
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), key)
    return local.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")

