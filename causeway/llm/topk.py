"""Exact top-k search: tiles of queries and shards, partial selection, tree merge."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, SHARD, FAN_IN = 1024, 4096, 16
_TILE = "query_id long, query_key long, asked long, shard long, vec_id long, score long"


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer inner products; a score beyond 64 bits is held at the bound."""
    if not queries.size or not shard.size:
        return np.zeros((len(queries), len(shard)), np.int64)
    if np.abs(queries).max() * np.abs(shard).max() * queries.shape[1] < 2.0**53:
        return (queries @ shard.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in shard], object).T
    return np.array([[min(max(x, -(2**63)), 2**63 - 1) for x in r] for r in whole], np.int64)


def _tile(k: int):
    def run(key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, asked in queries.groupby(queries["vec"].map(len)) if len(queries) and len(shard) else ():
            there = shard[shard["held_vec"].map(len) == size]
            if not len(there):
                continue
            ids, keys, first = there["held_id"].to_numpy(), there["held_key"].to_numpy(), there["copy"].to_numpy() == 1
            scores = products(np.floor(256.0 * np.stack(asked["vec"]).astype(float)), np.floor(256.0 * np.stack(there["held_vec"]).astype(float)))
            for query, mark, times, row in zip(asked["vec_id"], asked["row_key"], asked["asked"], scores):
                other = ~((ids == query) & (keys == mark) & first)
                got, left = ids[other], row[other]
                if len(left) > k:  # all that reach the k-th score, then ties by id
                    best = left >= np.partition(left, len(left) - k)[len(left) - k]
                    got, left = got[best], left[best]
                order = np.lexsort((got, -left.astype(object) if len(left) and left.min() == -(2**63) else -left))[:k]
                out.append(pd.DataFrame({"query_id": query, "query_key": mark, "asked": times, "shard": key[1], "vec_id": got[order], "score": left[order]}))
        if not out:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query_key", "asked", "shard", "vec_id", "score")})
        return pd.concat(out, ignore_index=True)

    return run


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK, shard_rows: int = SHARD, fan_in: int = FAN_IN,
) -> DataFrame:
    """Per query its ``k`` highest inner products over all other rows: query_id, rank, vec_id, score.

    Components are turned into floor(256 * x) first; ties go to the smaller id. Rows
    are dealt to query blocks and shards of bounded size by a hash, every pair of a
    block and a shard is one tile (a matrix product with selection of ``k`` a query),
    and the lists of a query are merged ``fan_in`` shards at a time.

    A null id or vector, and a null, NaN or infinite component, keep a row out. Only
    vectors of the query's own length are its candidates. Rows that repeat id and vector
    are scored once and count as often as they are there (``k`` others at most can
    reach a list); each of them that is a query has its own list, and only the query's own row is no
    candidate. Other columns are ignored. ``is_query`` is a condition on a row of ``vectors``. An empty table gives an empty result.
    """
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    rows = (
        vectors.where(is_query.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"), is_query.alias("asked"))
        .where(F.col("vec_id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
        .groupBy("vec_id", "vec").agg(F.count("*").alias("copies"), F.count_if("asked").alias("asked"))
        .withColumn("row_key", F.xxhash64("vec_id", "vec"))
    )
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("asked") > 0)).first()
    blocks, shards = max(1, math.ceil(asked / query_block)), max(1, math.ceil(n / shard_rows))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    queries = rows.where("asked > 0").select("vec_id", "row_key", "asked", "vec", F.pmod("row_key", F.lit(blocks)).alias("block"), numbers(shards).alias("shard"))
    held = rows.select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k + 1)))).alias("copy"))
    held = held.select(F.col("vec_id").alias("held_id"), F.col("row_key").alias("held_key"), "copy", F.col("vec").alias("held_vec"), F.pmod(F.xxhash64("row_key"), F.lit(shards)).alias("shard"), numbers(blocks).alias("block"))
    best = queries.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInPandas(_tile(k), _TILE)
    left, order = shards, [F.desc("score"), F.asc("vec_id")]
    while True:
        left = math.ceil(left / fan_in)
        best = best.withColumn("shard", F.floor(F.col("shard") / fan_in))
        place = F.row_number().over(Window.partitionBy("query_id", "query_key", "shard").orderBy(*order))
        best = best.withColumn("rank", place).where(F.col("rank") <= k)
        if left <= 1:
            return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("asked").cast("int"))).alias("copy")).drop("copy")
