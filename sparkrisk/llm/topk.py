"""Exact top-k inner products: tiles of queries and candidates, best of each tile, then best of the bests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.session import materialized

#: Rows of a tile; its product takes 8 bytes a cell.
QUERY_ROWS, SHARD_ROWS = 1024, 4096
#: Shards whose lists one task merges at a level of the tree.
FAN_IN = 16


def whole_components(vector: Column) -> Column:
    """floor(1024 * x) of every component in double precision; null where the vector is null or holds a
    null, non-finite or (as a whole number) unrepresentable component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(1024 * x.cast("double")) < F.lit(2.0 ** 62)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(1024 * x.cast("double"))))


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Which of a tile's scores are among the k highest of their row; ties go to the columns on the left.

    One selection over the whole tile finds each row's k-th highest score; what is above it is in, and of what equals it as
    many as there is room for.
    """
    if scores.shape[1] <= k:
        return allowed
    low = np.iinfo(np.int64).min
    held = np.where(allowed, scores, low)
    least = np.partition(held, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, equal = held > least, held == least
    return (above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True))) & allowed


def _tile(k: int):
    def multiply(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ("row", "query_id", "shard", "vec_id", "score")
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        rows = rows.sort_values("id", kind="stable")
        a, b = np.stack(queries["v"].to_numpy()).astype(np.int64), np.stack(rows["v"].to_numpy()).astype(np.int64)
        width = a.shape[1]
        bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
        # below 2^53 every sum of products is exact in a double, and the product runs on vector units
        product = (a.astype(float) @ b.astype(float).T).astype(np.int64) if bound < 2.0 ** 53 else a @ b.T
        own, other = queries["row"].to_numpy(), rows["row"].to_numpy()
        q, c = np.nonzero(_best(product, own[:, None] != other[None], k))
        return pd.DataFrame(dict(zip(names, (own[q], queries["id"].to_numpy()[q], np.full(len(q), rows["shard"].iloc[0]), rows["id"].to_numpy()[c], product[q, c]))))
    return multiply


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding",
          query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for every query row its k best other rows.

    Every row but the query's own is a candidate, a repeated row with the same id too. Vectors that are
    null or hold a null or non-finite component, and rows without an id, take no part; vectors of another
    length than the query's aren't comparable and are no candidates. Scores beyond 64 bits are undefined.
    Tiles are dealt by (query block, shard), so neither a frequent vector nor a frequent query is a group.
    """
    rows = materialized(vectors.select(F.col(f"`{id}`").cast("long").alias("id"), whole_components(F.col(f"`{vector}`")).alias("v"), is_query.alias("q"))
                        .where("v is not null and id is not null").withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.size("v")))
    n, m = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    place = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    numbers = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    fields = [F.col(c).alias(c) for c in ("width", "row", "id", "v")]  # aliases: the two sides come from one table
    asked = rows.where("q").select(*fields, place(blocks).alias("block"), numbers(shards).alias("shard"))
    given = rows.select(*fields, place(shards).alias("shard"), numbers(blocks).alias("block"))
    keys = ["width", "block", "shard"]
    lists = (asked.groupBy(*keys).cogroup(given.groupBy(*keys))
             .applyInPandas(_tile(k), "row long, query_id long, shard long, vec_id long, score long"))
    lists, width = materialized(lists), shards
    order = [F.desc("score"), F.asc("vec_id")]
    while width > FAN_IN:
        lists, width = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)), -(-width // FAN_IN)
        place_ = Window.partitionBy("row", "shard").orderBy(*order)
        lists = materialized(lists.withColumn("rank", F.row_number().over(place_)).where(F.col("rank") <= k).drop("rank"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
