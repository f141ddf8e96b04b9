"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship", "history_features", "history_features_with_ties", "history_features_hot_entity", "temporal_split",
    "global_rank", "ranking_metrics_by_split", "budget_table", "split_report", "derive_policies", "compare_models",
    "policy_report", "entity_state", "categorical_psi", "drift_report", "stream_features", "score_stream", "score_batch",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from sparkrisk.plans.catalog import PLANS
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the JVM threads
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {n: round(events / times[n]) for n in ("history_features", "split_report", "drift_report", "stream_features",
                                                   "score_stream") if n in times}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "events_per_second": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
