"""Chronological split and its checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import time_axis
from ..functions.ordering import DIRECT_SORT_ROWS, asc, at_or_before, beside, keys_at_ranks
from ..functions.roles import Roles

PARTS = ["train", "val", "test"]


def temporal_split(df: DataFrame, roles: Roles, train: float = 0.7, val: float = 0.15, test: float = 0.15,
                   direct_rows: int = DIRECT_SORT_ROWS) -> DataFrame:
    """Add ``split``: the first int(n*train) rows in (time, id) order are train, and so on.

    Rows without a time aren't counted in n and go to test, so that nothing undated is learned from.
    Only two boundary keys are looked up, on two narrow columns; wide rows are never shuffled.
    """
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    t, _ = time_axis(df, roles.time)
    order = [asc("__t"), asc("__id")]
    keyed = df.select(t.alias("__t"), F.col(roles.id).alias("__id"))
    # the same float floor on the driver as int() gives
    n, (end_train, end_val) = keys_at_ranks(
        keyed, order, lambda n: [int(n * train), int(n * (train + val))], direct_rows)
    out = df.withColumns({"__t": t, "__id": F.col(roles.id)})
    never = F.lit(False)
    in_train = at_or_before(order, end_train) if end_train else never
    in_val = at_or_before(order, end_val) if end_val else never
    return out.withColumn("split", F.when(in_train, "train").when(in_val, "val").otherwise("test")) \
        .drop("__t", "__id")


def split_metadata(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows, share, time and id bounds per part."""
    t, units = time_axis(df, roles.time)
    per = df.select("split", t.alias("t"), F.col(roles.id).alias("i")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("time_min"), F.max("t").alias("time_max"))
    few = Window.partitionBy(F.lit(0))  # three rows
    return per.select(
        "split", "n_rows", (F.col("n_rows") / F.sum("n_rows").over(few)).alias("share"),
        (F.col("time_min") / F.lit(float(units))).alias("time_min"),
        (F.col("time_max") / F.lit(float(units))).alias("time_max"))


def split_overlap(df: DataFrame, id_col: str) -> DataFrame:
    """Ids seen in more than one part, from one grouping by id."""
    def has(part):
        return F.max((F.col("split") == part).cast("int"))
    per_id = df.groupBy(id_col).agg(*[has(p).alias(p) for p in PARTS])
    def both(a, b):
        return F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("long").alias(f"overlap_{a}_{b}")
    return per_id.agg(F.count(F.lit(1)).alias("n_distinct_ids"),
                      (F.sum("train") + F.sum("val") + F.sum("test")).cast("long").alias("sum_of_parts"),
                      both("train", "val"), both("train", "test"), both("val", "test"))


def verify_split(df: DataFrame, roles: Roles) -> DataFrame:
    """Order, proportions and overlap recomputed from the rows (A5), one row."""
    t, units = time_axis(df, roles.time)
    parts = df.select("split", t.alias("t")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    def of(part, c):
        return F.max(F.when(F.col("split") == part, F.col(c)))
    wide = parts.agg(*[F.coalesce(of(p, "n"), F.lit(0)).alias(f"n_{p}") for p in PARTS],
                     F.coalesce(of("train", "hi") <= of("val", "lo"), F.lit(True)).alias("train_before_val"),
                     F.coalesce(of("val", "hi") <= of("test", "lo"), F.lit(True)).alias("val_before_test"))
    n = reduce(lambda a, b: a + b, [F.col(f"n_{p}") for p in PARTS])
    wide = wide.withColumns({f"share_{p}": F.col(f"n_{p}") / n for p in PARTS})
    overlap = split_overlap(df, roles.id)
    return beside(wide, overlap).withColumn(
        "disjoint", F.col("n_distinct_ids") == F.col("sum_of_parts"))


def first_n_by_time(df: DataFrame, roles: Roles, n: int) -> DataFrame:
    """The first n rows in (time, id) order (P13); rows without a time have no place in it.

    The boundary row is looked up, and every row compared with it where it is.
    """
    t, _ = time_axis(df, roles.time)
    order = [asc("__t"), asc("__id")]
    keyed = df.withColumns({"__t": t, "__id": F.col(roles.id)})
    _, keys = keys_at_ranks(keyed, order, lambda rows: [min(n, rows)])
    kept = keyed.where(at_or_before(order, keys[0])) if keys[0] is not None else keyed.where(F.lit(False))
    return kept.drop("__t", "__id")


def union_partitions(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Narrow columns of several parts as one table."""
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
