"""Connected components as repeated joins; nothing of the graph passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.session import materialized


def _smallest(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``a``; written, so that the join that follows can split a hub."""
    return materialized(pairs.groupBy("a").agg(F.min("b").alias("low")))


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node hands its larger, then its smaller neighbours to the least node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = F.least("low", "a")
    large = (both.join(_smallest(both), "a").where(F.col("b") > F.col("a"))
             .select(F.col("b").alias("a"), low.alias("b")).distinct())
    large = materialized(large)  # every edge points from the larger to the smaller node
    held = large.join(_smallest(large), "a")
    small = held.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(large.groupBy("a").agg(F.min("b").alias("b")))
    return materialized(small.distinct())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of the edges ``a``, ``b``.

    Nodes are longs. Loops and repeated edges are harmless, edges with a null end are ignored; no
    edges give no rows. Each round is a written table, so a lost executor repeats one round at most.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = materialized(edges.distinct()), None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return pairs.union(pairs.select("component", "component").distinct())
        before, edges = tuple(state), _stars(edges)
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
