"""Per-entity state from history (A7) and merging of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import time_axis
from ..functions.roles import Roles, require_columns

STATE_COLUMNS = ["entity", "n", "n_amt", "mean_amt", "m2", "min_amt", "max_amt", "last_time"]


def entity_state(df: DataFrame, roles: Roles) -> DataFrame:
    """Sufficient statistics per entity: one partial and one final aggregation.

    ``last_time`` is in the units of the time axis (microseconds for timestamps).
    """
    require_columns(df, [roles.time, roles.entity, roles.amount], "entity_state")
    t, _ = time_axis(df, roles.time)
    a = F.col(roles.amount).cast("double")
    return df.where(F.col(roles.entity).isNotNull()).groupBy(F.col(roles.entity).alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.count(a).alias("n_amt"), F.avg(a).alias("mean_amt"),
        F.coalesce(F.var_pop(a) * F.count(a), F.lit(0.0)).alias("m2"), F.min(a).alias("min_amt"),
        F.max(a).alias("max_amt"), F.max(t).alias("last_time"))


def recent_times(df: DataFrame, roles: Roles, as_of, width_seconds: int = 86400) -> DataFrame:
    """Event times within the width before ``as_of`` (inclusive): rows (entity, time, n).

    Kept as rows with a count rather than one array per entity, so a very busy entity stays
    spread over many rows.
    """
    t, units = time_axis(df, roles.time)
    keyed = df.where(F.col(roles.entity).isNotNull()).select(F.col(roles.entity).alias("entity"), t.alias("time"))
    return (keyed.where(F.col("time") >= F.lit(as_of) - F.lit(width_seconds * units))
            .groupBy("entity", "time").agg(F.count(F.lit(1)).alias("n")))


def merge_entity_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge two state tables by pairwise moments; the later time wins."""
    left = a.select("entity", *[F.col(c).alias(f"a_{c}") for c in STATE_COLUMNS[1:]])
    right = b.select("entity", *[F.col(c).alias(f"b_{c}") for c in STATE_COLUMNS[1:]])
    both = left.join(right, "entity", "full_outer")
    na, nb = F.coalesce("a_n_amt", F.lit(0)), F.coalesce("b_n_amt", F.lit(0))
    n = F.nullif(na + nb, F.lit(0))
    delta = F.col("b_mean_amt") - F.col("a_mean_amt")
    def total(c, zero):
        return F.coalesce(f"a_{c}", F.lit(zero)) + F.coalesce(f"b_{c}", F.lit(zero))
    return both.select(
        "entity", total("n", 0).alias("n"), total("n_amt", 0).alias("n_amt"),
        F.coalesce(F.col("a_mean_amt") + delta * nb / n, "a_mean_amt", "b_mean_amt").alias("mean_amt"),
        (total("m2", 0.0) + F.coalesce(delta * delta * na * nb / n, F.lit(0.0))).alias("m2"),
        F.least("a_min_amt", "b_min_amt").alias("min_amt"), F.greatest("a_max_amt", "b_max_amt").alias("max_amt"),
        F.greatest("a_last_time", "b_last_time").alias("last_time"))


def merge_recent_times(a: DataFrame, b: DataFrame, as_of, width: int) -> DataFrame:
    """Union of recent times, pruned again to the width before ``as_of`` (axis units)."""
    return (a.unionByName(b).where(F.col("time") >= F.lit(as_of) - F.lit(width))
            .groupBy("entity", "time").agg(F.sum("n").alias("n")))
