"""Sources, row checks, profiling, split and state plans (S, P, A, T1, J6, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions.expressions import time_axis
from ..functions.ordering import asc, global_rank
from ..functions.session import scratch_path
from ..operators import compare, history, monitor, profile, rows, split, state
from ..sources import artifacts, tables
from .bindings import (EVENTS, HISTORY_COLUMNS, ORDERS, SQL_EVENTS, SQL_GAPS, SQL_HISTORY, SQL_ORDERS, SQL_SPLIT,
                       decide_sql, history_sql, labelled_events, labelled_orders, split_events, split_sql, table, with_gaps)
from .registry import plan

# ---- sources and sinks ---------------------------------------------------------------

ORDER_COLUMNS = "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderpriority:s"


@plan("read_transactions", ORDER_COLUMNS, "select * from orders")
def read_transactions(spark, d):
    return tables.read_transactions(spark, f"{d}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@plan("read_transactions_csv", ORDER_COLUMNS, "select * from orders")
def read_transactions_csv(spark, d):
    src = read_transactions(spark, d)
    path = artifacts.write_artifact(src, scratch_path(spark, "orders-csv"), "csv")
    return tables.read_transactions(spark, path, src.schema, "csv")


@plan("narrow_schema", "l_returnflag:s n:l sum_linenumber:l sum_quantity:d sum_price:d", """
  select l_returnflag, count(*) as n, sum(l_linenumber) as sum_linenumber, sum(l_quantity) as sum_quantity,
    sum(cast(l_extendedprice as float)::double) as sum_price from lineitem group by 1""", digits=2)
def narrow_schema(spark, d):
    slim = tables.narrow_schema(table(spark, d, "lineitem"), ids=["l_orderkey", "l_partkey", "l_suppkey"])
    return slim.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("sum_linenumber"), F.sum("l_quantity").alias("sum_quantity"),
        F.sum(F.col("l_extendedprice").cast("double")).alias("sum_price"))


@plan("sampled_schema", "name:s kind:s", """select * from (values ('event_id', 'bigint'), ('user_id', 'int'), ('event_type', 'string'), ('value', 'float')) v(name, kind)""")
def sampled_schema(spark, d):
    """The schema of a CSV copy, inferred from a tenth of its rows; the id stays wide."""
    path = scratch_path(spark, "csv")
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.option("header", True).csv(path)
    fields = tables.sampled_schema(spark, path, 0.1, ids=["event_id"]).fields
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "name string, kind string")


VALIDATE_COLUMNS = ("n_rows:l n_duplicate_ids:l n_bad_labels:l n_missing_time:l time_is_numeric:b problems:s")


@plan("validate_table", VALIDATE_COLUMNS, f"""
  select count(*) as n_rows, count(*) - count(distinct event_id) as n_duplicate_ids,
    count(*) filter (label not in (0, 1)) as n_bad_labels, count(*) filter (t is null) as n_missing_time,
    true as time_is_numeric, '' as problems from {SQL_EVENTS} e""")
def validate_table(spark, d):
    return tables.validate_table(labelled_events(spark, d), EVENTS, strict=True)


@plan("validate_table_with_problems", VALIDATE_COLUMNS, """
  select n_rows, n_duplicate_ids, n_bad_labels, n_missing_time, true as time_is_numeric,
    n_duplicate_ids || ' duplicate id(s); ' || n_bad_labels || ' label(s) outside {0,1}' as problems
  from (select count(*) as n_rows, count(*) - count(distinct o_custkey) as n_duplicate_ids,
    count(*) filter (o_custkey % 3 not in (0, 1)) as n_bad_labels, 0 as n_missing_time from orders) o""")
def validate_table_with_problems(spark, d):
    df = table(spark, d, "orders").withColumn("label", F.col("o_custkey") % 3)
    return tables.validate_table(df, tables.Roles(id="o_custkey", time="o_orderdate", label="label"))


@plan("artifact_round_trip", "split:s n_rows:l share:d time_min:d time_max:d", f"""
  select split, count(*) as n_rows, count(*) / sum(count(*)) over () as share, min(t) / 1000000.0::double as time_min,
    max(t) / 1000000.0::double as time_max from {SQL_SPLIT} s group by split""")
def artifact_round_trip(spark, d):
    meta = split.split_metadata(split_events(spark, d), EVENTS)
    path = artifacts.write_artifact(meta, scratch_path(spark, "split-metadata"), "json")
    return artifacts.read_artifact(spark, path, "json", meta.schema)


STATE_COLUMNS = "entity:l n:l n_amt:l mean_amt:d m2:d min_amt:d max_amt:d last_time:l"
SQL_STATE = """(select user_id as entity, count(*) as n, count(value) as n_amt, avg(value) as mean_amt,
  coalesce(var_pop(value) * count(value), 0) as m2, min(value) as min_amt, max(value) as max_amt, max(t) as last_time
  from {src} s group by user_id)"""


@plan("snapshot_and_restore_state", STATE_COLUMNS, f"select * from {SQL_STATE.format(src=SQL_EVENTS)} x", digits=3)
def snapshot_and_restore_state(spark, d):
    path = artifacts.snapshot_state(state.entity_state(labelled_events(spark, d), EVENTS), scratch_path(spark, "state"))
    return artifacts.restore_state(spark, path)


# ---- projections and checks -----------------------------------------------------------

PATTERNS = [("identity", r".*_id"), ("category", r"event_type"), ("json", r"props")]
SQL_SCHEMA = f"""(select * from (values
  ('event_id', 'bigint', 'numeric', 'id', false, 'identifier'), ('ts', 'timestamp_ntz', 'categorical', 'time', false, 'raw time'),
  ('user_id', 'bigint', 'numeric', 'identity', true, null), ('event_type', 'string', 'categorical', 'category', true, null),
  ('value', 'double', 'numeric', 'amount', true, null), ('props', 'string', 'categorical', 'json', true, null),
  ('label', 'int', 'numeric', 'target', false, 'target')) v(name, dtype, value_type, feature_group, used, exclusion_reason)
  join (unpivot (select avg((event_id is null)::int) as event_id, avg((ts is null)::int) as ts, avg((user_id is null)::int) as user_id,
    avg((event_type is null)::int) as event_type, avg((value is null)::int) as value, 0.0::double as props,
    avg((label is null)::int) as label from {SQL_GAPS} g) on columns(*) into name name value null_rate) r using (name))"""


def _gappy(spark, d):
    return with_gaps(labelled_events(spark, d)).drop("score", "score_b")


@plan("feature_schema", "name:s dtype:s value_type:s feature_group:s null_rate:d used:b exclusion_reason:s",
      f"select * from {SQL_SCHEMA} s")
def feature_schema(spark, d):
    return profile.feature_schema(_gappy(spark, d), EVENTS, PATTERNS)


@plan("feature_schema_summary", "metric:s value:l", f"""
  with s as (select * from {SQL_SCHEMA} q)
  select 'n_total' as metric, count(*) as value from s union all select 'n_used', count(*) from s where used
  union all select 'n_excluded', count(*) from s where not used
  union all select 'n_numeric_used', count(*) from s where used and value_type = 'numeric'
  union all select 'n_categorical_used', count(*) from s where used and value_type = 'categorical'
  union all select 'used_in_' || feature_group, count(*) from s where used group by feature_group""")
def feature_schema_summary(spark, d):
    return profile.feature_schema_summary(feature_schema(spark, d))


@plan("select_features", "event_id:l value:d event_type:s", f"""
  select event_id, value, coalesce(event_type, '__missing__') as event_type from {SQL_GAPS} g""")
def select_features(spark, d):
    return rows.select_features(_gappy(spark, d), ["value"], ["event_type"], keep=["event_id"])


@plan("cast_target", "label:l n:l", f"select label, count(*) as n from {SQL_EVENTS} e group by label")
def cast_target(spark, d):
    df = table(spark, d, "events").withColumn("label", (F.col("event_type") == "error").cast("double"))
    return rows.cast_target(df, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@plan("leakage_guard", "user_id:l n:l", "select user_id, count(*) as n from events group by user_id")
def leakage_guard(spark, d):
    df = rows.leakage_guard(table(spark, d, "events"), "label", ["event_id", "ts", "user_id", "value"])
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _texts(spark, d):
    """Events as a sloppy producer would send them: text amounts, absent keys, negative amounts."""
    amount = (F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 13 == 0, "Infinity")
              .when(F.col("event_id") % 17 == 0, F.concat(F.lit("-"), F.col("value").cast("string")))
              .otherwise(F.col("value").cast("string")))
    t, _ = time_axis(table(spark, d, "events"), "ts")
    return table(spark, d, "events").select(
        "event_id", t.alias("ts"), F.when(F.col("event_id") % 19 != 0, F.col("user_id")).alias("user_id"),
        amount.alias("value"), F.when(F.col("event_id") % 23 == 0, 1).cast("int").alias("label"))


SQL_ERRORS = """case when event_id % 23 = 0 then 'label_present:label'
  when event_id % 19 = 0 then 'field_null:user_id'
  when event_id % 11 = 0 then 'not_a_number:value' when event_id % 13 = 0 then 'not_finite:value'
  when event_id % 17 = 0 and value > 0 then 'negative:value' end"""


@plan("validate_rows", "event_id:l error_reason:s", f"select event_id, {SQL_ERRORS} as error_reason from events")
def validate_rows(spark, d):
    return rows.row_errors(_texts(spark, d), EVENTS).select("event_id", "error_reason")


@plan("validate_json_rows", "event_id:l error_reason:s", f"""
  select event_id, case when event_id % 29 = 0 then 'malformed:raw' when event_id % 31 = 0 then 'malformed:raw'
    when event_id % 37 = 0 then 'label_present:label' when event_id % 23 = 0 then 'label_present:label'
    when event_id % 41 = 0 then 'field_absent:value' when event_id % 19 = 0 and event_id % 2 = 0 then 'field_absent:user_id'
    else {SQL_ERRORS} end as error_reason from events""")
def validate_json_rows(spark, d):
    """Messages cut short, arrays in place of objects, labels that are null, absent amounts, absent and null entities."""
    at = F.col("event_id")
    fields = _texts(spark, d)
    whole = F.to_json(F.struct(*[F.col(c) for c in fields.columns if c not in ("user_id", "value", "label")]))
    more = F.concat(F.when((at % 19 != 0), F.concat(F.lit(',"user_id":'), F.col("user_id").cast("string"))).when(at % 2 != 0, ',"user_id":null').otherwise(""),
                    F.when(at % 41 == 0, "").otherwise(F.concat(F.lit(',"value":"'), F.col("value"), F.lit('"'))),
                    F.when(at % 37 == 0, ',"label":null').when(F.col("label").isNotNull(), ',"label":1').otherwise(""), F.lit("}"))
    raw = F.concat(F.expr("substr(__w, 1, length(__w) - 1)"), more)
    raw = F.when(at % 29 == 0, raw.substr(F.lit(1), F.length(raw) - 2)).when(at % 31 == 0, F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw)
    return rows.row_errors(fields.withColumn("__w", whole).select("event_id", raw.alias("raw")), EVENTS, raw="raw").select("event_id", "error_reason")


@plan("complete_columns", "event_id:l value:d device:s distance:d", """
  select event_id, value, cast(null as varchar) as device, cast(null as double) as distance from events""")
def complete_columns(spark, d):
    want = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                         T.StructField("device", T.StringType()), T.StructField("distance", T.DoubleType())])
    return rows.complete_columns(table(spark, d, "events"), want)


@plan("coerce_numeric", "event_id:l value:d", """
  select event_id, case when event_id % 11 = 0 then null when event_id % 13 = 0 then null
    when event_id % 17 = 0 then -value else value end as value from events""")
def coerce_numeric(spark, d):
    out = rows.coerce_numeric(_texts(spark, d), ["value"])
    return out.select("event_id", F.when(F.abs("value") < float("inf"), F.col("value")).alias("value"))


@plan("decide", "event_id:l score:d decision:s",
      f"select event_id, score, {decide_sql('score', 0.1, 0.4)} as decision from {SQL_EVENTS} e")
def decide(spark, d):
    return rows.decided(labelled_events(spark, d), "score", 0.1, 0.4).select("event_id", "score", "decision")


SEGMENT_SQL = f"""(select quantile_cont(score, 0.5) as low, (select quantile_cont(score_b, 0.9) from {SQL_SPLIT} b
  where split = 'val') as high from {SQL_SPLIT} a where split = 'val')"""


@plan("segment_thresholds", "low:d high:d", f"select * from {SEGMENT_SQL} s")
def segment_thresholds(spark, d):
    return rows.segment_thresholds(split_events(spark, d).where("split = 'val'"), "score", "score_b")


@plan("segment_lift", "n_flagged:l positives_flagged:l rate_flagged:d overall_rate:d lift:d", f"""
  select n as n_flagged, p as positives_flagged, p / n::double as rate_flagged, o as overall_rate, p / n::double / o as lift from (
    select count(*) filter (score < low and score_b > high) as n, sum(label) filter (score < low and score_b > high) as p,
      avg(label) as o from {SQL_SPLIT} e cross join {SEGMENT_SQL} s where split = 'test') x""")
def segment_lift(spark, d):
    parts = split_events(spark, d)
    cut = rows.segment_thresholds(parts.where("split = 'val'"), "score", "score_b").first()
    return rows.segment_lift(parts.where("split = 'test'"), "score", "score_b", cut["low"], cut["high"])


@plan("missing_optional_count", "event_id:l n_missing_optional:l safe_amount:d", f"""
  select event_id, (value is null)::int + (event_type is null)::int as n_missing_optional, value as safe_amount from {SQL_GAPS} g""")
def missing_optional_count(spark, d):
    df = rows.missing_optional_count(_gappy(spark, d).drop("props"), ["event_id", "ts", "user_id", "label"])
    return df.select("event_id", "n_missing_optional", rows.safe_amount("value").alias("safe_amount"))


@plan("first_n_by_time", "o_orderkey:l o_custkey:l", """
  select o_orderkey, o_custkey from orders order by o_orderdate, o_orderkey limit 3000""")
def first_n_by_time(spark, d):
    return split.first_n_by_time(table(spark, d, "orders"), ORDERS, 3000).select("o_orderkey", "o_custkey")


# ---- history -----------------------------------------------------------------------------

@plan("history_features", f"event_id:l {HISTORY_COLUMNS}", f"select * from {SQL_HISTORY} h")
def history_features(spark, d):
    return history.history_features(table(spark, d, "events"), EVENTS)


@plan("history_features_with_ties", f"o_orderkey:l {HISTORY_COLUMNS}",
      f"select * from {history_sql(SQL_ORDERS, 'o_orderkey', 'o_custkey', 'o_totalprice')} h", digits=3)
def history_features_with_ties(spark, d):
    return history.history_features(table(spark, d, "orders"), ORDERS)


@plan("history_features_with_gaps", f"event_id:l {HISTORY_COLUMNS}",
      f"select * from {history_sql(SQL_GAPS, 'event_id', 'user_id', 'value')} h")
def history_features_with_gaps(spark, d):
    return history.history_features(_gappy(spark, d).drop("label"), EVENTS, forbid=["label"])


@plan("history_features_hot_entity", f"event_id:l {HISTORY_COLUMNS}", f"""select * from {history_sql(
    "(select event_id, value, epoch_us(ts) as t, case when user_id % 3 = 0 then 0 else user_id end as user_id from events)",
    'event_id', 'user_id', 'value')} h""")
def history_features_hot_entity(spark, d):
    """A third of all rows on one entity; it is cut into chunks, the others take the plain plan."""
    df = table(spark, d, "events").withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    n = df.count()
    return history.history_features(df, EVENTS, hot_rows=n // 10)


TWICE = """(select event_id, value, user_id, case when event_id % 11 = 3 then null else epoch_us(ts) end as t,
  case when event_id % 3 = 0 then 2 else 1 end as times from events)"""
SQL_TWICE = f"""(select e.*, row_number() over (order by t, event_id, copy) as rid from (select event_id, value, t, copy,
  case when user_id % 3 = 0 then 0 else user_id end as user_id from {TWICE} o join (values (1), (2)) c(copy) on copy <= times) e)"""


@plan("history_features_hot_duplicates", f"event_id:l {HISTORY_COLUMNS}", f"""
  select event_id, {', '.join(c.split(':')[0] for c in HISTORY_COLUMNS.split())} from {history_sql(f"(select * from {SQL_TWICE} a where t is not null)", 'rid', 'user_id', 'value', 'event_id')} h
  union all select event_id, 0, 0, null, null, null, null, null, null, null, null, 0, 0 from {SQL_TWICE} b where t is null""")
def history_features_hot_duplicates(spark, d):
    """Each third event is delivered twice, some have no time, and a third of all rows share an entity that is cut into chunks."""
    e = table(spark, d, "events").withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    e = e.withColumn("ts", F.when(F.col("event_id") % 11 != 3, F.col("ts")))
    e = e.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1)))).drop("copy")
    return history.history_features(e, EVENTS, hot_rows=e.count() // 10)


@plan("history_diagnostics", "metric:s value:d", f"""
  with h as (select * from {history_sql(SQL_EVENTS, 'event_id', 'user_id', 'value', 'user_id')} q),
  one as (select avg((bhv_prev_txn_count = 0)::int) as cold_start_share, min(bhv_prev_txn_count)::double as prev_count_min,
    avg(bhv_prev_txn_count) as prev_count_mean, max(bhv_prev_txn_count)::double as prev_count_max,
    quantile_cont(bhv_prev_txn_count, 0.25) as prev_count_p25, quantile_cont(bhv_prev_txn_count, 0.5) as prev_count_p50,
    quantile_cont(bhv_prev_txn_count, 0.75) as prev_count_p75, quantile_cont(bhv_prev_txn_count, 0.95) as prev_count_p95,
    quantile_cont(bhv_time_since_prev_txn, 0.5) as recency_p50, quantile_cont(bhv_time_since_prev_txn, 0.95) as recency_p95,
    avg((bhv_time_since_prev_txn is null)::int) as recency_missing_share,
    count(*) filter (abs(bhv_amt_zscore) > 5) / count(*)::double as extreme_zscore_share,
    count(distinct user_id)::double as n_entities, count(*) / count(distinct user_id)::double as rows_per_entity,
    {', '.join(f"avg(({c} is null)::int) as null_share_{c}" for c in history.feature_names())} from h)
  unpivot one on columns(*) into name metric value value""", digits=4)
def history_diagnostics(spark, d):
    return history.history_diagnostics(history.history_features(table(spark, d, "events"), EVENTS, keep=["user_id"]), "user_id")


# ---- profiling -----------------------------------------------------------------------------

@plan("structure_report", "n_rows:l n_columns:l n_duplicate_ids:l n_negative:l n_positive:l positive_rate:d", f"""
  select count(*) as n_rows, 7 as n_columns, count(*) - count(distinct event_id) as n_duplicate_ids,
    count(*) filter (label = 0) as n_negative, count(*) filter (label = 1) as n_positive, avg(label) as positive_rate from {SQL_EVENTS} e""")
def structure_report(spark, d):
    return profile.structure_report(labelled_events(spark, d).drop("score", "score_b"), EVENTS)


@plan("temporal_bins", "bin:l n_rows:l positive_rate:d", f"""
  select greatest(1, least(20, cast(ceil((t - lo) * 20.0::double / (hi - lo)) as bigint))) as bin, count(*) as n_rows,
    avg(label) as positive_rate from {SQL_EVENTS} e cross join (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events) m
  group by 1""")
def temporal_bins(spark, d):
    return profile.temporal_bins(labelled_events(spark, d), EVENTS)


@plan("temporal_summary", "n_rows:l time_min:d time_max:d range_seconds:d range_days:d train_end_time:d val_end_time:d", f"""
  select count(*) as n_rows, min(t) / 1e6 as time_min, max(t) / 1e6 as time_max, (max(t) - min(t)) / 1e6 as range_seconds,
    round((max(t) - min(t)) / 86400e6, 1) as range_days, max(t) filter (split = 'train') / 1e6 as train_end_time,
    max(t) filter (split = 'val') / 1e6 as val_end_time from {SQL_SPLIT} s""", digits=3)
def temporal_summary(spark, d):
    return profile.temporal_summary(labelled_events(spark, d), EVENTS)


@plan("missingness_by_group", "feature_group:s n_columns:l mean_null_rate:d max_null_rate:d min_null_rate:d most_missing:s", f"""
  select feature_group, count(*) as n_columns, avg(null_rate) as mean_null_rate, max(null_rate) as max_null_rate,
    min(null_rate) as min_null_rate, string_agg(name, ',' order by null_rate desc, name) as most_missing
  from {SQL_SCHEMA} s group by feature_group""")
def missingness_by_group(spark, d):
    return profile.missingness_by_group(feature_schema(spark, d))


def _key_sql(name: str, keys: str) -> str:
    whole = " and ".join(f"{k.strip()} is not null" for k in keys.split(","))
    return f"""select '{name}' as entity_key, (select count(*) from k) as n_rows, (select count(*) from k where not ({whole})) as n_null_key,
      count(*) as cardinality, quantile_cont(c, 0.5) as median_rows, avg(c) as mean_rows, max(c) as max_rows,
      avg((c = 1)::int) as singleton_share from (select count(*) as c from k where {whole} group by {keys}) g"""


@plan("entity_key_profile", "entity_key:s n_rows:l n_null_key:l cardinality:l median_rows:d mean_rows:d max_rows:l singleton_share:d", f"""
  with k as (select case when o_orderkey % 9 <> 0 then o_custkey end as o_custkey, o_orderpriority from orders)
  {_key_sql('o_custkey', 'o_custkey')} union all {_key_sql('o_custkey+o_orderpriority', 'o_custkey, o_orderpriority')}""")
def entity_key_profile(spark, d):
    df = table(spark, d, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")))
    return profile.entity_key_profile(df, [["o_custkey"], ["o_custkey", "o_orderpriority"]])


@plan("class_balance", "n_negative:l n_positive:l positive_weight:d", f"""
  select count(*) filter (label = 0) as n_negative, count(*) filter (label = 1) as n_positive,
    count(*) filter (label = 0) / count(*) filter (label = 1)::double as positive_weight from {SQL_SPLIT} s where split = 'train'""")
def class_balance(spark, d):
    return profile.class_balance(split_events(spark, d).where("split = 'train'"), "label")


# ---- split -----------------------------------------------------------------------------------

SQL_ORDER_SPLIT = split_sql(SQL_ORDERS, "o_orderkey")


@plan("global_rank", "o_orderkey:l rank:l n_rows:l", f"""
  select o_orderkey, row_number() over (order by t, o_orderkey) as rank, count(*) over () as n_rows from {SQL_ORDERS} o""")
def ranks(spark, d):
    t, _ = time_axis(table(spark, d, "orders"), "o_orderdate")
    keyed = table(spark, d, "orders").select("o_orderkey", t.alias("t"))
    return global_rank(keyed, [asc("t"), asc("o_orderkey")], keep=["o_orderkey"])


@plan("temporal_split", "o_orderkey:l split:s", f"select o_orderkey, split from {SQL_ORDER_SPLIT} s")
def temporal_split(spark, d):
    return split.temporal_split(labelled_orders(spark, d), ORDERS).select("o_orderkey", "split")


@plan("temporal_split_by_brackets", "o_orderkey:l split:s", f"select o_orderkey, split from {SQL_ORDER_SPLIT} s")
def temporal_split_by_brackets(spark, d):
    """The way taken beyond a size: quantile brackets and exact counts instead of a sort."""
    return split.temporal_split(labelled_orders(spark, d), ORDERS, direct_rows=0).select("o_orderkey", "split")


SQL_UNDATED = f"""(select o_orderkey, split from {split_sql("(select o_orderkey, epoch_us(o_orderdate) as t from orders where o_orderkey % 7 <> 1)", "o_orderkey")} a
  union all select o_orderkey, 'test' from orders where o_orderkey % 7 = 1)"""


def _undated(spark, d):
    return labelled_orders(spark, d).withColumn("o_orderdate", F.when(F.col("o_orderkey") % 7 != 1, F.col("o_orderdate")))


@plan("temporal_split_null_times", "o_orderkey:l split:s", f"select o_orderkey, split from {SQL_UNDATED} s")
def temporal_split_null_times(spark, d):
    """Rows without a time don't count, and go to test."""
    return split.temporal_split(_undated(spark, d), ORDERS).select("o_orderkey", "split")


@plan("temporal_split_null_times_by_brackets", "o_orderkey:l split:s", f"select o_orderkey, split from {SQL_UNDATED} s")
def temporal_split_null_times_by_brackets(spark, d):
    """The same beyond the size at which nothing is sorted."""
    return split.temporal_split(_undated(spark, d), ORDERS, direct_rows=0).select("o_orderkey", "split")


@plan("verify_split", "n_train:l n_val:l n_test:l train_before_val:b val_before_test:b share_train:d share_val:d share_test:d "
      "n_distinct_ids:l sum_of_parts:l overlap_train_val:l overlap_train_test:l overlap_val_test:l disjoint:b", f"""
  select *, n_train / n::double as share_train, n_val / n::double as share_val, n_test / n::double as share_test,
    n as sum_of_parts, 0 as overlap_train_val, 0 as overlap_train_test, 0 as overlap_val_test, n = n_distinct_ids as disjoint from (
    select count(*) as n, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'val') as n_val,
      count(*) filter (split = 'test') as n_test, max(t) filter (split = 'train') <= min(t) filter (split = 'val') as train_before_val,
      max(t) filter (split = 'val') <= min(t) filter (split = 'test') as val_before_test, count(distinct o_orderkey) as n_distinct_ids
    from {SQL_ORDER_SPLIT} s) x""")
def verify_split(spark, d):
    return split.verify_split(split.temporal_split(labelled_orders(spark, d), ORDERS), ORDERS)


@plan("split_overlap", "n_distinct_ids:l sum_of_parts:l overlap_train_val:l overlap_train_test:l overlap_val_test:l", f"""
  with s as (select distinct o_custkey, split from {SQL_ORDER_SPLIT} q),
  w as (select o_custkey, max((split = 'train')::int) as a, max((split = 'val')::int) as b, max((split = 'test')::int) as c from s group by 1)
  select count(*) as n_distinct_ids, sum(a + b + c) as sum_of_parts, sum(a * b) as overlap_train_val, sum(a * c) as overlap_train_test,
    sum(b * c) as overlap_val_test from w""")
def split_overlap(spark, d):
    return split.split_overlap(split.temporal_split(labelled_orders(spark, d), ORDERS), "o_custkey")


@plan("union_partitions", "o_orderkey:l o_custkey:l o_totalprice:d", "select o_orderkey, o_custkey, o_totalprice from orders")
def union_partitions(spark, d):
    df = split.temporal_split(labelled_orders(spark, d), ORDERS)
    return split.union_partitions([df.where(F.col("split") == p) for p in split.PARTS], ["o_orderkey", "o_custkey", "o_totalprice"])


# ---- state -------------------------------------------------------------------------------------

@plan("entity_state", STATE_COLUMNS, f"select * from {SQL_STATE.format(src=SQL_GAPS)} x", digits=3)
def entity_state(spark, d):
    return state.entity_state(_gappy(spark, d), EVENTS)


@plan("recent_times", "entity:l time:l n:l", f"""
  select user_id as entity, t as time, count(*) as n from {SQL_SPLIT} s
  where split = 'train' and t >= (select max(t) from {SQL_SPLIT} q where split = 'train') - 86400000000 group by 1, 2""")
def recent_times(spark, d):
    train = split_events(spark, d).where("split = 'train'")
    t, _ = time_axis(train, "ts")
    return state.recent_times(train, EVENTS, train.agg(F.max(t)).first()[0])


@plan("merge_entity_state", STATE_COLUMNS, f"select * from {SQL_STATE.format(src=SQL_EVENTS)} x", digits=3)
def merge_entity_state(spark, d):
    parts = split_events(spark, d)
    return state.merge_entity_state(state.entity_state(parts.where("split = 'train'"), EVENTS),
                                    state.entity_state(parts.where("split <> 'train'"), EVENTS))


@plan("merge_recent_times", "entity:l time:l n:l", f"""
  select user_id as entity, t as time, count(*) as n from {SQL_EVENTS} s where t >= (select max(t) from {SQL_EVENTS} q) - 86400000000 group by 1, 2""")
def merge_recent_times(spark, d):
    """The last day's times of two parts of the table, merged, are those of the whole."""
    e = table(spark, d, "events")
    t, _ = time_axis(e, "ts")
    as_of = e.agg(F.max(t)).first()[0]
    odd, even = (state.recent_times(e.where(F.col("event_id") % 2 == k), EVENTS, as_of) for k in (1, 0))
    return state.merge_recent_times(odd, even, as_of, 86_400_000_000)


# ---- logs ----------------------------------------------------------------------------------------

def _log(spark, d):
    return rows.decided(labelled_events(spark, d), "score", 0.1, 0.4)


@plan("decision_log_summary", "metric:s value:d", f"""
  with l as (select *, {decide_sql('score', 0.1, 0.4)} as decision, event_type = 'signup' as bad from {SQL_EVENTS} e),
  one as (select count(*)::double as attempts, count(*) filter (not bad)::double as successes, count(*) filter (bad)::double as failures,
    {', '.join(f"count(*) filter (not bad and decision = '{x}')::double as count_{x}, count(*) filter (not bad and decision = '{x}') / count(*) filter (not bad)::double as share_{x}" for x in ('APPROVE', 'REVIEW', 'BLOCK'))},
    {', '.join(f"count({c}) filter (not bad)::double as {n}_count, avg({c}) filter (not bad) as {n}_mean, min({c}) filter (not bad) as {n}_min, max({c}) filter (not bad) as {n}_max" for n, c in (('score', 'score'), ('amount', 'value')))} from l)
  unpivot one on columns(*) into name metric value value""")
def decision_log_summary(spark, d):
    log = _log(spark, d).withColumn("bad", F.col("event_type") == "signup")
    return monitor.decision_log_summary(log, "score", "value", "decision", failed="bad")


@plan("score_buckets", "bucket:s n:l", f"""
  select printf('%.1f-%.1f', b / 10.0::double, (b + 1) / 10.0::double) as bucket, coalesce(n, 0) as n from (select unnest(range(10)) as b) r
  left join (select least(cast(floor(score * 10) as bigint), 9) as b, count(*) as n from {SQL_EVENTS} e group by 1) c using (b)""")
def score_buckets(spark, d):
    return monitor.score_buckets(_log(spark, d))


def _requests(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.concat(F.lit("/"), "event_type").alias("endpoint"), (F.lit(200) + (k % 4) * 100).alias("status"), F.col("value").alias("latency_ms"))


SQL_REQUESTS = """(select '/' || event_type as endpoint, 200 + (cast(json_extract_string(props, '$.k') as bigint) % 4) * 100 as status,
  value as latency_ms from events)"""


@plan("request_log_summary", "scope:s key:s n_requests:l mean_latency_ms:d", f"""
  with r as (select *, (status // 100) || 'xx' as klass from {SQL_REQUESTS} q)
  select 'total' as scope, 'all' as key, count(*) as n_requests, avg(latency_ms) as mean_latency_ms from r
  union all select 'endpoint', endpoint, count(*), avg(latency_ms) from r group by endpoint
  union all select 'status_class', klass, count(*), avg(latency_ms) from r group by klass""")
def request_log_summary(spark, d):
    return monitor.request_log_summary(_requests(spark, d))


@plan("latency_summary", "endpoint:s n:l mean_ms:d per_second:d p50:d p95:d p99:d", f"""
  select endpoint, n, m as mean_ms, 1000 / m as per_second,
    {', '.join(f"l[cast(least(floor(n * {p}::double), n - 1) as bigint) + 1] as p{int(p * 100)}" for p in (0.5, 0.95, 0.99))}
  from (select endpoint, count(*) as n, avg(latency_ms) as m, list(latency_ms order by latency_ms) as l from {SQL_REQUESTS} q group by endpoint) x""")
def latency_summary(spark, d):
    return monitor.latency_summary(_requests(spark, d), by=["endpoint"])
