"""Summaries of decision, request and latency logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import DECISIONS, bin_label, count_if, ratio, unit_bin
from ..functions.ordering import asc, running_totals


def decision_log_summary(log: DataFrame, score="score", amount="amount", decision="decision", failed: str | None = None) -> DataFrame:
    """(metric, value) rows: attempts, counts and shares by decision, score and amount summaries."""
    bad = F.col(failed) if failed else F.lit(False)
    ok = ~bad
    n_ok = count_if(ok)
    one = log.agg(
        F.count(F.lit(1)).cast("double").alias("attempts"), n_ok.cast("double").alias("successes"),
        count_if(bad).cast("double").alias("failures"),
        *[c for d in DECISIONS for c in (
            count_if(ok & (F.col(decision) == d)).cast("double").alias(f"count_{d}"),
            ratio(count_if(ok & (F.col(decision) == d)), n_ok).alias(f"share_{d}"))],
        *[c for name, col in (("score", F.when(ok, F.col(score))), ("amount", F.when(ok, F.col(amount)))) for c in (
            F.count(col).cast("double").alias(f"{name}_count"), F.avg(col).alias(f"{name}_mean"),
            F.min(col).cast("double").alias(f"{name}_min"), F.max(col).cast("double").alias(f"{name}_max"))])
    return one.unpivot([], one.columns, "metric", "value")


def score_buckets(log: DataFrame, score="score") -> DataFrame:
    """Rows per score decile, 1.0 in the last."""
    counts = log.where(F.col(score).isNotNull()).groupBy(unit_bin(F.col(score), 10).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = log.sparkSession.range(10).select(F.col("id").cast("int").alias("b"))
    return every.join(counts, "b", "left").select(bin_label(F.col("b")).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def request_log_summary(log: DataFrame, endpoint="endpoint", status="status", latency="latency_ms") -> DataFrame:
    """Requests and mean latency overall, by endpoint and by status class (A10), from one grouping."""
    klass = F.concat(F.floor(F.col(status) / 100).cast("string"), F.lit("xx"))
    base = log.groupBy(F.col(endpoint).alias("e"), klass.alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(latency).alias("t"))
    keys = F.array(F.struct(F.lit("total").alias("scope"), F.lit("all").alias("key")),
                   F.struct(F.lit("endpoint").alias("scope"), F.col("e").alias("key")),
                   F.struct(F.lit("status_class").alias("scope"), F.col("s").alias("key")))
    return base.withColumn("k", F.explode(keys)).groupBy("k.scope", "k.key").agg(
        F.sum("n").alias("n_requests"), ratio(F.sum("t"), F.sum("n")).alias("mean_latency_ms"))


def latency_summary(log: DataFrame, latency="latency_ms", by: Sequence[str] = ("component",),
                    quantiles: Sequence[float] = (0.50, 0.95, 0.99)) -> DataFrame:
    """Per component: n, mean, per-second rate and percentiles at index min(int(n*p), n-1)."""
    by = list(by)
    counts = log.where(F.col(latency).isNotNull()).groupBy(*by, F.col(latency).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    runs = running_totals(counts, [asc("v")], {"n": F.col("n")}, by, ["v"])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1

    def at(p):
        index = F.least(F.floor(F.col("total_n") * F.lit(p)), F.col("total_n") - 1)
        return F.max(F.when(index.between(first, last), F.col("v"))).alias(f"p{round(p * 100)}")

    total = F.sum(F.col("v") * F.col("n"))
    return runs.groupBy(*by).agg(F.max("total_n").alias("n"), ratio(total, F.max("total_n")).alias("mean_ms"),
                                 ratio(F.max("total_n") * 1000.0, total).alias("per_second"), *[at(p) for p in quantiles])
