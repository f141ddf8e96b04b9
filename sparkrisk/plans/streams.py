"""Streaming plans (S4-S6, G1-G10): the event table as files that arrive one after another."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..functions.roles import Roles
from ..functions.session import scratch_path
from ..operators import compare, history, rows
from ..operators.history import feature_names
from ..operators.split import temporal_split
from ..sources import streams
from ..streaming import flow
from .bindings import EVENTS, HISTORY_COLUMNS, SQL_EVENTS, SQL_HISTORY, SQL_SPLIT, decide_sql, history_sql, split_events, table
from .registry import plan


def event_stream(spark, d):
    """The table itself as a file stream."""
    return streams.file_stream(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)


def run_parts(spark, parts, build, mode="append", pause=0.0):
    """Deliver tables one after another, each as many files, and run the stream over each on one checkpoint."""
    path, out, state = (scratch_path(spark, n) for n in ("arrivals", "stream-out", "stream-state"))
    result = None
    for i, p in enumerate(parts):
        p.write.mode("append").parquet(path)
        if i and pause:
            time.sleep(pause)
        result = flow.run_available(build(streams.file_stream(spark, path, p.schema)), out, state, mode)
    return result


def by_split(spark, d, names=("train", "val", "test"), change=lambda df: df):
    parts = change(split_events(spark, d))
    return [parts.where(F.col("split") == p).drop("split") for p in names]


def run(df, mode="append"):
    spark = df.sparkSession
    return flow.run_available(df, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state"), mode)


def scored(df):
    z = F.coalesce(F.col("bhv_amt_zscore"), F.lit(0.0))
    return rows.decided(df.withColumn("score", 1.0 / (1.0 + F.exp(-z / 2.0))), "score", 0.3, 0.6)


@plan("stream_source", "event_type:s n:l", "select event_type, count(*) as n from events group by 1")
def stream_source(spark, d):
    raw = event_stream(spark, d).select(F.to_json(F.struct("event_id", "event_type", "value")).alias("raw"))
    from pyspark.sql import types as T
    schema = T.StructType().add("event_id", "long").add("event_type", "string").add("value", "double")
    return run(streams.parse_messages(raw, schema)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@plan("decision_sink", "transaction_id:l risk_score:d decision:s policy_version:s", f"""
  select event_id as transaction_id, score as risk_score, {decide_sql('score', 0.1, 0.4)} as decision, 'v1' as policy_version from {SQL_EVENTS} e""")
def decision_sink(spark, d):
    live = rows.decided(event_stream(spark, d).withColumn("score", F.least(F.col("value") / 500.0, F.lit(1.0))), "score", 0.1, 0.4)
    out = scratch_path(spark, "decisions")
    streams.write_stream(streams.decision_columns(live, "event_id", "v1"), out, scratch_path(spark, "decisions-state"))
    return spark.read.parquet(out)


def _sometimes_bad(df):
    return df.withColumns({"value": F.when(F.col("event_id") % 17 == 0, -F.col("value") - 1).otherwise(F.col("value")),
                           "user_id": F.when(F.col("event_id") % 19 != 0, F.col("user_id"))})


BAD_SQL = """case when event_id % 19 = 0 then 'field_null:user_id'
  when event_id % 17 = 0 then 'negative:value' end"""


@plan("dead_letter_sink", "event_id:l error:s", f"select event_id, {BAD_SQL} as error from events where event_id % 17 = 0 or event_id % 19 = 0")
def dead_letter_sink(spark, d):
    checked = rows.row_errors(_sometimes_bad(event_stream(spark, d)), EVENTS)
    good, bad = scratch_path(spark, "accepted"), scratch_path(spark, "dead-letters")
    query = (checked.writeStream.foreachBatch(streams.split_sink(good, bad)).trigger(availableNow=True)
             .option("checkpointLocation", scratch_path(spark, "dead-letters-state")).start())
    query.awaitTermination()
    return spark.read.parquet(bad).select(
        F.get_json_object("original_transaction", "$.event_id").cast("long").alias("event_id"), "error")


@plan("stream_features", f"event_id:l {HISTORY_COLUMNS}", f"select * from {SQL_HISTORY} h")
def stream_features(spark, d):
    """Keyed state fed in three micro-batches gives what the windows give."""
    return run_parts(spark, by_split(spark, d), lambda live: flow.stream_features(live, EVENTS)).select("event_id", *feature_names())


@plan("stream_warm_start", f"event_id:l {HISTORY_COLUMNS}", f"""
  select h.* from {SQL_HISTORY} h join {SQL_SPLIT} s on s.event_id = h.event_id where split <> 'train'""")
def stream_warm_start(spark, d):
    """State from the train rows, then only later rows as a stream."""
    parts = split_events(spark, d)
    initial = flow.warm_start_table(parts.where("split = 'train'"), EVENTS)
    return run_parts(spark, by_split(spark, d, ("val", "test")),
                     lambda live: flow.stream_features(live, EVENTS, initial=initial)).select("event_id", *feature_names())


VELOCITY_SQL = history_sql("(select event_id, value, epoch_us(ts) as t, user_id % 3 as user_id from events)", "event_id", "user_id", "value")


@plan("stream_velocity_hot_entity", "event_id:l bhv_prior_count_1h:l bhv_prior_count_24h:l",
      f"select event_id, bhv_prior_count_1h, bhv_prior_count_24h from {VELOCITY_SQL} h")
def stream_velocity_hot_entity(spark, d):
    """Three entities hold all events; their recent times spill into buckets."""
    parts = by_split(spark, d, change=lambda df: df.withColumn("user_id", F.col("user_id") % 3))
    out = run_parts(spark, parts, lambda live: flow.stream_features(live, EVENTS))
    return out.select("event_id", "bhv_prior_count_1h", "bhv_prior_count_24h")


@plan("stream_snapshot_restore", f"event_id:l {HISTORY_COLUMNS}", f"""
  select h.* from {VELOCITY_SQL} h join {SQL_SPLIT} s on s.event_id = h.event_id where split = 'test'""")
def stream_snapshot_restore(spark, d):
    """Two deliveries on one checkpoint, their state read out of it, a second query on the rest. Few times are kept inline, so the
    map's buckets are part of the state."""
    parts = by_split(spark, d, change=lambda df: df.withColumn("user_id", F.col("user_id") % 3))
    path, out, state = (scratch_path(spark, n) for n in ("arrivals", "stream-out", "stream-state"))
    for p in parts[:2]:
        p.write.mode("append").parquet(path)
        flow.run_available(flow.stream_features(streams.file_stream(spark, path, p.schema), EVENTS, inline_times=16), out, state)
    initial = flow.state_snapshot(spark, state)
    rest = run_parts(spark, parts[2:], lambda live: flow.stream_features(live, EVENTS, initial=initial, inline_times=16))
    return rest.select("event_id", *feature_names())


@plan("stream_state_ttl", f"event_id:l {HISTORY_COLUMNS}", f"select * from {SQL_HISTORY} h")
def stream_state_ttl(spark, d):
    """State that expires after a day without events; nothing expires within this run."""
    return run(flow.stream_features(event_stream(spark, d), EVENTS, ttl_ms=86_400_000)).select("event_id", *feature_names())


def _in_part(names):
    return history_sql(f"(select * from {SQL_SPLIT} z where split in ({names}))", "event_id", "user_id", "value")


@plan("stream_state_expiry", f"event_id:l {HISTORY_COLUMNS}", f"""
  select * from {_in_part("'train'")} a union all select * from {_in_part("'val', 'test'")} b""")
def stream_state_expiry(spark, d):
    """State older than a second has expired when the second delivery comes: its events begin anew."""
    parts = split_events(spark, d)
    two = [parts.where("split = 'train'").drop("split"), parts.where("split <> 'train'").drop("split")]
    out = run_parts(spark, two, lambda live: flow.stream_features(live, EVENTS, ttl_ms=1000), pause=3.0)
    return out.select("event_id", *feature_names())


@plan("stream_null_entity", f"event_id:l {HISTORY_COLUMNS}", f"""
  select {', '.join(['event_id', *feature_names()])} from {history_sql("(select event_id, value, user_id, epoch_us(ts) as t from events where event_id % 5 <> 2)", 'event_id', 'user_id', 'value')} h
  union all select event_id, 0, 0, null, null, null, null, null, null, null, null, 0, 0 from events where event_id % 5 = 2""")
def stream_null_entity(spark, d):
    """Events without an entity have no history, in the stream as in the batch."""
    parts = by_split(spark, d, change=lambda df: df.withColumn("user_id", F.when(F.col("event_id") % 5 != 2, F.col("user_id"))))
    return run_parts(spark, parts, lambda live: flow.stream_features(live, EVENTS)).select("event_id", *feature_names())


LATE_SQL = f"""(select s.event_id, split = 'train' and exists (select 1 from {SQL_SPLIT} v where v.split = 'val' and v.user_id = s.user_id and v.t > s.t) as is_late
  from {SQL_SPLIT} s)"""


@plan("stream_late_events", "event_id:l is_late:b error_reason:s has_score:b", f"""
  select event_id, is_late, case when is_late then 'late' end as error_reason, not is_late as has_score from {LATE_SQL} x""")
def stream_late_events(spark, d):
    """Deliveries out of order, each twice, with a short memory: every event comes out once, late ones by name."""
    val, train, test = by_split(spark, d, ("val", "train", "test"), lambda df: df.drop("label", "score", "score_b"))
    out = run_parts(spark, [val, train, train, test], lambda live: flow.score_stream(live, EVENTS, scored, delay="10 minutes", late="route"))
    return out.select("event_id", "is_late", "error_reason", F.col("score").isNotNull().alias("has_score"))


@plan("dedup_stream", "event_id:l value:d", "select event_id, value from events")
def dedup_stream(spark, d):
    """Every event delivered twice comes out once."""
    events = table(spark, d, "events")
    # out of order and with a short memory: nothing is late, and nothing comes twice
    newest_first = [events.where("event_id % 2 = 1"), events, events]
    return run_parts(spark, newest_first, lambda live: flow.dedup_stream(live, "event_id", "10 minutes")).select("event_id", "value")


@plan("route_invalid", "kind:s n:l", """
  select case when event_id % 17 = 0 or event_id % 19 = 0 then 'invalid' else 'valid' end as kind, count(*) as n from events group by 1""")
def route_invalid(spark, d):
    valid, invalid = flow.route_invalid(_sometimes_bad(event_stream(spark, d)), EVENTS)
    tagged = valid.select("event_id", F.lit("valid").alias("kind")).unionByName(invalid.select("event_id", F.lit("invalid").alias("kind")))
    return run(tagged).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


GOOD_SQL = "(select event_id, user_id, value, ts, epoch_us(ts) as t from events where event_id % 17 <> 0 and event_id % 19 <> 0)"


@plan("score_stream", "event_id:l decision:s error_reason:s score:d", f"""
  select h.event_id, case when score < 0.3 then 'APPROVE' when score < 0.6 then 'REVIEW' else 'BLOCK' end as decision, null as error_reason, score
  from (select event_id, 1.0 / (1.0 + exp(-coalesce(bhv_amt_zscore, 0) / 2.0)) as score
    from {history_sql(GOOD_SQL, 'event_id', 'user_id', 'value')} q) h
  union all select event_id, null, {BAD_SQL}, null from events, (values (1), (2)) twice(n) where event_id % 17 = 0 or event_id % 19 = 0""")
def score_stream(spark, d):
    """Validation, deduplication, state, score, decision and rejection in one streaming query."""
    events = _sometimes_bad(table(spark, d, "events"))
    # valid repeats are dropped; a rejected event is reported each time it arrives
    out = run_parts(spark, [events, events], lambda live: flow.score_stream(live, EVENTS, scored, delay="10 minutes"))
    return out.select("event_id", "decision", "error_reason", "score")


@plan("stream_monitor", "window_start:s metric:s value:s n:l", f"""
  with e as (select time_bucket(interval 1 hour, ts) as w, event_id, score, case when event_id % 13 = 0 then 'bad' end as error,
    case when event_id % 13 <> 0 then {decide_sql('score', 0.1, 0.4)} end as decision from {SQL_EVENTS} q),
  m as (select w, 'decision' as metric, decision as value from e union all
    select w, 'score_bucket', least(floor(score * 10)::int, 9)::varchar from e union all select w, 'failure', error from e)
  select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, metric, value, count(*) as n from m where value is not null group by 1, 2, 3""")
def stream_monitor(spark, d):
    """Decisions, score buckets and failures per hour, the later half of the events delivered first. The first query is stopped
    between two batches, the second goes on where it was."""
    events = table(spark, d, "events")
    middle = F.lit(events.agg(F.median("event_id")).first()[0])
    path, counts, state = (scratch_path(spark, n) for n in ("arrivals", "monitor", "monitor-state"))

    def query():
        live = streams.file_stream(spark, path, events.schema, max_files_per_trigger=1)
        live = rows.decided(live.withColumn("score", F.least(F.col("value") / 500.0, F.lit(1.0))), "score", 0.1, 0.4)
        bad = F.col("event_id") % 13 == 0
        live = live.withColumns({"error": F.when(bad, "bad"), "decision": F.when(~bad, F.col("decision"))})
        return live.writeStream.option("checkpointLocation", state).foreachBatch(flow.monitor_sink(counts, time_col="ts", score="score", error="error"))
    events.where(F.col("event_id") > middle).repartition(3).write.parquet(path)
    running = query().trigger(processingTime="100 milliseconds").start()
    while running.isActive and not running.recentProgress:
        time.sleep(0.05)
    flow.stop_after_batch(running)
    events.where(F.col("event_id") <= middle).repartition(2).write.mode("append").parquet(path)
    query().trigger(availableNow=True).start().awaitTermination()
    return flow.monitor_totals(spark, counts).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@plan("bounded_run", "n_rows:l n_epochs:l", "select count(*) as n_rows, 3 as n_epochs from events")
def bounded_run(spark, d):
    """availableNow takes what each of three deliveries brought in one batch, and stops."""
    return run_parts(spark, by_split(spark, d), lambda live: live).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("epoch").alias("n_epochs"))


@plan("replay_parity", "n_rows_compared:l n_features_compared:l n_rows_matching:l n_mismatches:l max_abs_diff:d scores_compared:l "
      "score_mismatches:l decisions_matching:l", f"""
  select count(*) as n_rows_compared, 12 * count(*) as n_features_compared, count(*) as n_rows_matching, 0 as n_mismatches, 0 as max_abs_diff,
    count(*) as scores_compared, 0 as score_mismatches, count(*) as decisions_matching from {SQL_SPLIT} s where split <> 'train'""")
def replay_parity(spark, d):
    """Later events replayed as a stream against the batch result: features, scores, decisions."""
    parts = split_events(spark, d)
    initial = flow.warm_start_table(parts.where("split = 'train'"), EVENTS)
    online = run_parts(spark, by_split(spark, d, ("val", "test")), lambda live: scored(flow.stream_features(live, EVENTS, initial=initial)))
    offline = scored(history.history_features(parts, EVENTS))
    from ..functions.ordering import beside
    f = compare.feature_parity(online, offline, "event_id", feature_names(), tolerance=1e-4)
    s = compare.score_parity(online, offline, "event_id").select(F.col("n_compared").alias("scores_compared"), F.col("n_mismatches").alias("score_mismatches"))
    k = compare.decision_parity(online, offline, "event_id").select(F.col("n_matching").alias("decisions_matching"))
    return beside(f, s, k)
