"""Drift plans (R1-R9, U2): train rows are the reference, later days are the batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import materialized, scratch_path
from ..operators import drift, history, rows
from ..operators.split import temporal_split
from .bindings import EVENTS, SQL_EVENTS, decide_sql, history_sql, labelled_events, split_sql, table
from .registry import plan

NUMERIC = ["value", "k"]
BEHAVIORAL = ["bhv_prev_txn_count", "bhv_time_since_prev_txn", "bhv_prior_count_24h"]
CATEGORICAL = ["event_type", "k_text"]
SIGNALS = [*NUMERIC, *BEHAVIORAL, "score"]


def monitored(spark, d):
    """Scored events with history, decision and the day as batch key."""
    k = F.get_json_object("props", "$.k")
    keep = ["ts", "value", "score", "event_type", "props", "user_id"]
    feats = history.history_features(labelled_events(spark, d), EVENTS, keep=keep)
    out = rows.decided(feats, "score", 0.1, 0.4).withColumns({
        "k": k.cast("double"), "batch": F.date_format("ts", "yyyy-MM-dd"),
        # a category that only shows up in later days, and one that disappears
        "k_text": F.when(F.col("user_id") % 40 == 7, F.concat(F.lit("u"), F.date_format("ts", "dd"))).otherwise(k)})
    # every signal reads these rows several times: the history is computed once
    return materialized(temporal_split(out, EVENTS))


def _parts(spark, d):
    df = monitored(spark, d)
    return df.where("split = 'train'"), df.where("split <> 'train'")


SQL_MONITORED = f"""(select h.*, case when user_id % 40 = 7 then 'u' || strftime(ts, '%d') else json_extract_string(props, '$.k') end as k_text,
  json_extract_string(props, '$.k')::double as k, strftime(ts, '%Y-%m-%d') as batch, {decide_sql('score', 0.1, 0.4)} as decision
  from {history_sql(SQL_EVENTS, 'event_id', 'user_id', 'value', 'ts, t, value, score, event_type, props, user_id')} h)"""
SQL_PARTS = split_sql(SQL_MONITORED)
LONG_CELLS = ", ".join(f"('{f}', {f}::double)" for f in SIGNALS)
TEXT_CELLS = ", ".join(f"('{f}', coalesce({f}::varchar, '__missing__'))" for f in CATEGORICAL)
WITH = f"""with p as materialized (select * from {SQL_PARTS} p0),
  ref as (select v.feature, v.value from p, lateral (values {LONG_CELLS}) v(feature, value) where split = 'train'),
  cur as (select batch, v.feature, v.value from p, lateral (values {LONG_CELLS}) v(feature, value) where split <> 'train'),
  ed as (select feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e
    from ref group by feature),
  edges as (select feature, e[2:len(e) - 1] as interior from ed),
  bins as (select feature, unnest(range(0, len(interior) + 1)) as bin from edges),
  rc as (select r.feature, len(list_filter(interior, lambda x: r.value >= x)) as bin, count(*) as n from ref r join edges using (feature)
    where value is not null group by 1, 2),
  rshare as (select b.feature, b.bin, coalesce(n, 0) as ref_count, coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by b.feature)::double as ref_share
    from bins b left join rc on b.feature = rc.feature and b.bin = rc.bin),
  tref as (select v.feature, v.category from p, lateral (values {TEXT_CELLS}) v(feature, category) where split = 'train'),
  tcur as (select batch, v.feature, v.category from p, lateral (values {TEXT_CELLS}) v(feature, category) where split <> 'train'),
  cats as (select *, case when freq >= 0.01 then category else '__OTHER__' end as grouped from (select feature, category, count(*) as n,
    count(*) / sum(count(*)) over (partition by feature)::double as freq from tref group by 1, 2) c),
  dref as (select 'decision_distribution' as feature, d as category, d as grouped, (select count(*) from p where split = 'train' and decision = d)
    / (select count(*) from p where split = 'train')::double as freq from (values ('APPROVE'), ('REVIEW'), ('BLOCK')) v(d)),
  dcur as (select batch, 'decision_distribution' as feature, decision as category from p where split <> 'train')"""


def severity_sql(x: str) -> str:
    return (f"case when {x} < 0.1 then 'NO_SIGNIFICANT_DRIFT' when {x} < 0.2 then 'LOW_DRIFT' when {x} < 0.3 then 'MODERATE_DRIFT' "
            f"else 'HIGH_DRIFT' end")


@plan("numeric_profile_bins", "feature:s bin:l ref_count:l ref_share:d", f"{WITH} select * from rshare")
def numeric_profile_bins(spark, d):
    ref, _ = _parts(spark, d)
    return drift.numeric_profile(drift.melt_numeric(ref, SIGNALS))[0].drop("interior")


STATS_COLUMNS = "feature:s kind:s n:l null_share:d mean:d median:d std:d min:d max:d"
KIND_SQL = "case when feature like 'bhv%' then 'behavioral' when feature = 'score' then 'score' else 'numeric' end"


@plan("reference_profile_stats", STATS_COLUMNS, f"""{WITH} select feature, {KIND_SQL} as kind, count(value) as n, avg((value is null)::int) as null_share,
  avg(value) as mean, quantile_cont(value, 0.5) as median, stddev_samp(value) as std, min(value) as min, max(value) as max from ref group by feature""", digits=4)
def reference_profile_stats(spark, d):
    """The whole profile is built, written and read back; its stats table is shown."""
    ref, _ = _parts(spark, d)
    built = drift.reference_profile(ref, NUMERIC, CATEGORICAL, "event_id", behavioral=BEHAVIORAL)
    path = scratch_path(spark, "profile")
    built.save(path)
    return drift.ReferenceProfile.load(spark, path).stats.select("feature", "kind", "n", "null_share", "mean", "median", "std", "min", "max")


@plan("categorical_profile", "feature:s category:s n:l freq:d grouped:s", f"{WITH} select * from cats")
def categorical_profile(spark, d):
    ref, _ = _parts(spark, d)
    return drift.categorical_profile(drift.melt_categorical(ref, CATEGORICAL))


NUMERIC_PSI = f"""npsi as (select g.batch, g.feature, sum((greatest(c, 1e-4) - greatest(ref_share, 1e-4)) * ln(greatest(c, 1e-4) / greatest(ref_share, 1e-4))) as psi,
    max(n_current) as n_current, max(m) as current_mean, max(med) as current_median from (
    select t.batch, t.feature, r.bin, r.ref_share, n_current, m, med, coalesce(coalesce(k.n, 0) / nullif(n_current, 0)::double, 0) as c from (
      select batch, feature, count(value) as n_current, avg(value) as m, quantile_cont(value, 0.5) as med from cur group by 1, 2) t
    join rshare r on r.feature = t.feature left join (select batch, c.feature, len(list_filter(interior, lambda x: c.value >= x)) as bin, count(*) as n
      from cur c join edges using (feature) where value is not null group by 1, 2, 3) k on k.batch = t.batch and k.feature = t.feature and k.bin = r.bin) g
  group by 1, 2)"""


@plan("numeric_psi", "batch:s feature:s psi:d n_current:l current_mean:d current_median:d severity:s",
      f"{WITH}, {NUMERIC_PSI} select *, {severity_sql('psi')} as severity from npsi", digits=5)
def numeric_psi(spark, d):
    ref, cur = _parts(spark, d)
    bins, _ = drift.numeric_profile(drift.melt_numeric(ref, SIGNALS))
    return drift.numeric_psi(bins, drift.melt_numeric(cur, SIGNALS, ["batch"]), ["batch"])


def cat_psi_sql(name: str, cats: str, cur: str) -> str:
    return f"""{name}_g as (select feature, grouped, sum(freq) as r from {cats} group by 1, 2),
    {name}_m as (select c.batch, c.feature, case when k.category is not null then c.category else '__OTHER__' end as grouped, count(*) as n from {cur} c
      left join {cats} k on k.feature = c.feature and k.category = c.category and k.grouped = k.category group by 1, 2, 3),
    {name}_t as (select batch, feature, count(*) as total from {cur} group by 1, 2),
    {name}_x as (select coalesce(a.batch, m.batch) as batch, coalesce(a.feature, m.feature) as feature, coalesce(a.grouped, m.grouped) as grouped,
      coalesce(r, 0) as r, coalesce(m.n, 0) as n from (select t.batch, g.* from {name}_t t join {name}_g g using (feature)) a
      full join {name}_m m on a.batch = m.batch and a.feature = m.feature and a.grouped = m.grouped),
    {name} as (select x.batch, x.feature, sum((greatest(n / total::double, 1e-4) - greatest(r, 1e-4)) * ln(greatest(n / total::double, 1e-4) / greatest(r, 1e-4))) as psi,
      max(total) as n_current from {name}_x x join {name}_t t on t.batch = x.batch and t.feature = x.feature group by 1, 2)"""


CHANGES = """ch as (select distinct c.batch, c.feature, c.category, 'new' as change from tcur c where not exists (
    select 1 from cats k where k.feature = c.feature and k.category = c.category)
  union all select t.batch, k.feature, k.category, 'missing' from (select distinct batch from tcur) t cross join cats k where not exists (
    select 1 from tcur c where c.batch = t.batch and c.feature = k.feature and c.category = k.category))"""


@plan("new_and_missing_categories", "batch:s feature:s category:s change:s", f"{WITH}, {CHANGES} select * from ch")
def new_and_missing_categories(spark, d):
    ref, cur = _parts(spark, d)
    cats = drift.categorical_profile(drift.melt_categorical(ref, CATEGORICAL))
    return drift.category_changes(cats, drift.melt_categorical(cur, CATEGORICAL, ["batch"]), ["batch"])


@plan("categorical_psi", "batch:s feature:s psi:d n_current:l n_new_categories:l n_missing_categories:l severity:s", f"""
  {WITH}, {cat_psi_sql('cp', 'cats', 'tcur')}, {CHANGES}
  select cp.*, (select count(*) from ch where ch.batch = cp.batch and ch.feature = cp.feature and change = 'new') as n_new_categories,
    (select count(*) from ch where ch.batch = cp.batch and ch.feature = cp.feature and change = 'missing') as n_missing_categories,
    {severity_sql('psi')} as severity from cp""", digits=5)
def categorical_psi(spark, d):
    ref, cur = _parts(spark, d)
    cats = drift.categorical_profile(drift.melt_categorical(ref, CATEGORICAL))
    return drift.categorical_psi(cats, drift.melt_categorical(cur, CATEGORICAL, ["batch"]), ["batch"])


@plan("decision_psi", "batch:s psi:d n_current:l severity:s",
      f"{WITH}, {cat_psi_sql('dp', 'dref', 'dcur')} select batch, psi, n_current, {severity_sql('psi')} as severity from dp", digits=5)
def decision_psi(spark, d):
    ref, cur = _parts(spark, d)
    return drift.categorical_psi(drift.decision_profile(ref), drift.melt_decisions(cur, by=["batch"]), ["batch"]).select(
        "batch", "psi", "n_current", "severity")


KS_P = ("greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1.0::double else -1.0::double end) "
        "* exp(-2.0::double * k * k * dd * dd * nr * nc / (nr + nc)::double)))))")


@plan("ks_two_sample", "feature:s n_reference:l n_current:l ks_statistic:d ks_p_value:d current_median:d", f"""{WITH},
  v as (select feature, value, sum(r) as r, sum(c) as c from (select feature, value, 1 as r, 0 as c from ref where value is not null
    union all select feature, value, 0, 1 from cur where value is not null) u group by 1, 2),
  s as (select feature, sum(r) over w as cr, sum(c) over w as cc, sum(r) over (partition by feature) as nr, sum(c) over (partition by feature) as nc
    from v window w as (partition by feature order by value)),
  g as (select feature, max(nr) as nr, max(nc) as nc, max(abs(cr / nr::double - cc / nc::double)) as dd from s group by feature)
  select feature, nr as n_reference, nc as n_current, dd as ks_statistic, {KS_P} as ks_p_value,
    (select quantile_cont(value, 0.5) from cur where cur.feature = g.feature) as current_median from g""")
def ks_two_sample(spark, d):
    ref, cur = _parts(spark, d)
    return drift.ks_two_sample(drift.melt_numeric(ref, SIGNALS), drift.melt_numeric(cur, SIGNALS), exact_rows=0)


@plan("ks_exact", "day:l n_reference:l n_current:l ks_statistic:d ks_p_value:d", f"""
  with recursive e as (select (epoch_us(ts) // 86400000000)::bigint as day, value from events), first as (select min(day) as f from e),
  ref as (select value from e where day = (select f from first)), cur as (select day, value from e where day > (select f from first)),
  v as (select day, value, sum(r) as r, sum(c) as c from (select day, ref.value, 1 as r, 0 as c from ref cross join (select distinct day from cur) dd union all select day, value, 0, 1 from cur) u group by 1, 2),
  s as (select day, sum(r) over w as cr, sum(c) over w as cc, sum(r) over p as nr, sum(c) over p as nc from v window w as (partition by day order by value), p as (partition by day)),
  g as materialized (select day, max(nr)::bigint as n, max(nc)::bigint as m, max(abs(cr * nc - cc * nr))::bigint as h from s group by day),
  way as (select day, n, m, h, 0::bigint as k, 0::bigint as i, 1.0::double as a, false as gone from g
    union all select day, n, m, h, k, i, sum(a), abs(i * m - (k - i) * n) >= h from (
      select day, n, m, h, k + 1 as k, i + x as i, a * case when x = 1 then (n - i) else (m - (k - i)) end / (n + m - k)::double as a
      from way, (values (0), (1)) t(x) where not gone and k < n + m and case when x = 1 then i < n else k - i < m end) z group by day, n, m, h, k, i)
  select day, n as n_reference, m as n_current, h / (n * m)::double as ks_statistic, least(1, sum(case when gone then a else 0 end)) as ks_p_value from way group by day, n, m, h""")
def ks_exact(spark, d):
    """Each day against the first one: a few hundred values each, so the p-value counts all orders of both."""
    df = table(spark, d, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"))
    first = df.agg(F.min("day")).first()[0]
    ref, cur = df.where(F.col("day") == first), df.where(F.col("day") > first)
    return drift.ks_two_sample(drift.melt_numeric(ref, ["value"]), drift.melt_numeric(cur, ["value"], ["day"]), ["day"]).select(
        "day", "n_reference", "n_current", "ks_statistic", "ks_p_value")


@plan("psi_severity", "batch:s severity:s n:l",
      f"{WITH}, {NUMERIC_PSI} select batch, {severity_sql('psi')} as severity, count(*) as n from npsi group by 1, 2")
def psi_severity(spark, d):
    return numeric_psi(spark, d).groupBy("batch", "severity").agg(F.count(F.lit(1)).alias("n"))


REPORT = f"""{NUMERIC_PSI}, {cat_psi_sql('cp', 'cats', 'tcur')}, {cat_psi_sql('dp', 'dref', 'dcur')}, {CHANGES},
  sig as (select batch, feature, psi from npsi union all select batch, feature, psi from cp union all select batch, feature, psi from dp),
  ranked as (select *, case when psi < 0.1 then 0 when psi < 0.2 then 1 when psi < 0.3 then 2 else 3 end as r from sig),
  worst as (select batch, max(r) as w from ranked group by batch),
  rep as (select b.batch, b.batch_rows, b.batch_rows < 30 as low_confidence,
    ['NO_SIGNIFICANT_DRIFT', 'LOW_DRIFT', 'MODERATE_DRIFT', 'HIGH_DRIFT'][w + 1] as overall_severity,
    (select string_agg(feature, ',' order by feature) from ranked q where q.batch = b.batch and q.r = w) as contributing_signals,
    coalesce((select string_agg(feature || ': ' || n || ' new category value(s)', '; ' order by feature) from (
      select batch, feature, count(*) as n from ch where change = 'new' group by 1, 2) z where z.batch = b.batch), '') as warnings
    from (select batch, count(*) as batch_rows from p where split <> 'train' group by batch) b join worst on worst.batch = b.batch)"""


def _report(spark, d):
    ref, cur = _parts(spark, d)
    prof = drift.reference_profile(ref, NUMERIC, CATEGORICAL, "event_id", behavioral=BEHAVIORAL)
    signals = drift.drift_signals(prof, cur, SIGNALS, CATEGORICAL, ["batch"], ks=False)
    return drift.drift_report(signals, cur, ["batch"])


@plan("drift_signals", "batch:s signal:s psi:d ks_statistic:d ks_p_value:d current_median:d n_current:l severity:s kind:s", f"""{WITH}, {NUMERIC_PSI},
  {cat_psi_sql('cp', 'cats', 'tcur')}, {cat_psi_sql('dp', 'dref', 'dcur')},
  keys as (select distinct batch, feature from cur),
  v as (select batch, feature, value, sum(r) as r, sum(c) as c from (select k.batch, r.feature, value, 1 as r, 0 as c from ref r join keys k using (feature)
    where value is not null union all select batch, feature, value, 0, 1 from cur where value is not null) u group by 1, 2, 3),
  s as (select batch, feature, sum(r) over w as cr, sum(c) over w as cc, sum(r) over (partition by batch, feature) as nr, sum(c) over (partition by batch, feature) as nc
    from v window w as (partition by batch, feature order by value)),
  g as (select batch, feature, max(nr) as nr, max(nc) as nc, max(abs(cr / nr::double - cc / nc::double)) as dd from s group by 1, 2)
  select n.batch, n.feature as signal, psi, case when nr > 1 and nc > 1 then dd end as ks_statistic, case when nr > 1 and nc > 1 then {KS_P} end as ks_p_value,
    current_median, n_current, {severity_sql('psi')} as severity, {KIND_SQL.replace('feature', 'n.feature')} as kind from npsi n join g on g.batch = n.batch and g.feature = n.feature
  union all select batch, feature, psi, null, null, null, n_current, {severity_sql('psi')}, 'categorical' from cp
  union all select batch, feature, psi, null, null, null, n_current, {severity_sql('psi')}, 'decision' from dp""", digits=5)
def drift_signals(spark, d):
    """Every signal of every batch, with the exact distance to the whole reference."""
    ref, cur = _parts(spark, d)
    prof = drift.reference_profile(ref, NUMERIC, CATEGORICAL, "event_id", behavioral=BEHAVIORAL)
    out = drift.drift_signals(prof, cur, SIGNALS, CATEGORICAL, ["batch"], exact_rows=0)
    return out.select("batch", "signal", "psi", "ks_statistic", "ks_p_value", "current_median", "n_current", "severity", "kind")


@plan("drift_report", "batch:s batch_rows:l low_confidence:b overall_severity:s contributing_signals:s warnings:s", f"{WITH}, {REPORT} select * from rep")
def drift_report(spark, d):
    return _report(spark, d)


@plan("drift_history", "batches_analysed:l n_no_significant_drift:l n_low_drift:l n_moderate_drift:l n_high_drift:l latest_status:s", f"""{WITH}, {REPORT}
  select count(*) as batches_analysed, count(*) filter (overall_severity = 'NO_SIGNIFICANT_DRIFT') as n_no_significant_drift,
    count(*) filter (overall_severity = 'LOW_DRIFT') as n_low_drift, count(*) filter (overall_severity = 'MODERATE_DRIFT') as n_moderate_drift,
    count(*) filter (overall_severity = 'HIGH_DRIFT') as n_high_drift, max_by(overall_severity, batch) as latest_status from rep""")
def drift_history(spark, d):
    return drift.drift_history(_report(spark, d), "batch")
