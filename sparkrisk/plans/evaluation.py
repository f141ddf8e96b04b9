"""Joins, parity, ranking, budget, policy and model-comparison plans (J, T2-T5, U2-U4, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import DecisionPolicy
from ..operators import compare, history, policy, ranking, rows
from ..operators.history import feature_names
from .bindings import (EVENTS, HISTORY_COLUMNS, SQL_DOCUMENTS, SQL_EVENTS, SQL_HISTORY, SQL_SPLIT, budgets_sql, curve_sql,
                       decide_sql, history_sql, labelled_documents, labelled_events, metrics_sql, ranked_sql, split_events,
                       table, values_sql)
from .registry import plan

BY_EVENT = dict(score="score", label="label", id_col="event_id")
APPROVE_AT, BLOCK_AT = 0.1, 0.4

# ---- joins and parity ----------------------------------------------------------------


@plan("attach_features", f"event_id:l event_type:s {HISTORY_COLUMNS}",
      f"select * from {history_sql(SQL_EVENTS, 'event_id', 'user_id', 'value', 'event_type')} h")
def attach_features(spark, d):
    events = table(spark, d, "events")
    return compare.attach_features(events.select("event_id", "event_type"), history.history_features(events, EVENTS), "event_id")


@plan("join_one_to_one", "doc_id:l source:s toxic:l quality:l",
      "select d.doc_id, source, toxic, quality from documents d left join labels l on d.doc_id = l.doc_id")
def join_one_to_one(spark, d):
    return compare.join_one_to_one(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


SQL_LATE = f"(select * from {SQL_SPLIT} l0 where split <> 'train')"


def _cold_and_full(spark, d):
    """History computed on val+test alone against history on all rows."""
    parts = split_events(spark, d)
    cold = history.history_features(parts.where("split <> 'train'"), EVENTS)
    return cold, history.history_features(parts, EVENTS)


def _parity_sql():
    cells = ", ".join(f"({i}, a.{c}::double, b.{c}::double)" for i, c in enumerate(feature_names()))
    return f"""with a as (select * from {history_sql(SQL_LATE, 'event_id', 'user_id', 'value')} x), b as (select * from {SQL_HISTORY} y),
      pairs as (select a.event_id, v.* from a join b on a.event_id = b.event_id, lateral (values {cells}) v(f, x, y)),
      m as (select event_id, f, case when x is null and y is null then true when x is null or y is null then false
        else abs(x - y) <= 1e-4 end as ok, abs(x - y) as diff from pairs),
      r as (select event_id, count(*) as n, count(*) filter (not ok) as bad, max(diff) filter (not ok) as worst from m group by event_id)
      select count(*) as n_rows_compared, sum(n) as n_features_compared, count(*) filter (bad = 0) as n_rows_matching,
        sum(bad) as n_mismatches, coalesce(max(worst), 0) as max_abs_diff from r"""


@plan("feature_parity", "n_rows_compared:l n_features_compared:l n_rows_matching:l n_mismatches:l max_abs_diff:d", _parity_sql())
def feature_parity(spark, d):
    cold, full = _cold_and_full(spark, d)
    return compare.feature_parity(cold, full, "event_id", feature_names(), tolerance=1e-4)


@plan("parity_examples", "event_id:l feature:s", f"""
  with a as (select * from {history_sql(SQL_LATE, 'event_id', 'user_id', 'value')} x), b as (select * from {SQL_HISTORY} y)
  select a.event_id, v.f as feature from a join b on a.event_id = b.event_id, lateral (values
    {', '.join(f"('{c}', a.{c}::double, b.{c}::double)" for c in feature_names())}) v(f, x, y)
  where (x is null) <> (y is null) or abs(x - y) > 1e-6 order by 1, 2 limit 50""")
def parity_examples(spark, d):
    cold, full = _cold_and_full(spark, d)
    pairs = compare.feature_pairs(cold, full, "event_id", feature_names())
    return compare.parity_examples(pairs, "event_id").select("event_id", "feature")


@plan("score_parity", "n_compared:l n_mismatches:l max_abs_diff:d mean_abs_diff:d correlation:d", f"""
  select count(*) as n_compared, count(*) filter (split = 'train' or abs(round(score, 2) - score) > 1e-3) as n_mismatches,
    max(abs(round(score, 2) - score)) filter (split <> 'train') as max_abs_diff,
    avg(abs(round(score, 2) - score)) filter (split <> 'train') as mean_abs_diff,
    corr(round(score, 2), score) filter (split <> 'train') as correlation from {SQL_SPLIT} s""")
def score_parity(spark, d):
    parts = split_events(spark, d)
    online = parts.select("event_id", F.round("score", 2).alias("score"))
    return compare.score_parity(online, parts.where("split <> 'train'").select("event_id", "score"), "event_id", tolerance=1e-3)


@plan("decision_parity", "n_compared:l n_matching:l n_mismatches:l share_matching:d", f"""
  select count(*) as n_compared, count(*) filter (a = b) as n_matching, count(*) filter (a <> b) as n_mismatches,
    avg((a = b)::int) as share_matching from (select {decide_sql('score', 0.1, 0.4)} as a, {decide_sql('score', 0.12, 0.4)} as b
    from {SQL_SPLIT} s where split <> 'train') x""")
def decision_parity(spark, d):
    parts = split_events(spark, d)
    offline = rows.decided(parts.where("split <> 'train'"), "score", 0.12, 0.4)
    return compare.decision_parity(rows.decided(parts, "score", 0.1, 0.4), offline, "event_id")


@plan("lookup_encode", "event_id:l freq:d", f"""
  select e.event_id, coalesce(f.freq, 0) as freq from {SQL_SPLIT} e left join (select k, count(*) / (select count(*) from {SQL_SPLIT} a
    where split = 'train')::double as freq from (select json_extract_string(props, '$.k') as k from {SQL_SPLIT} b where split = 'train') q group by k) f
  on json_extract_string(e.props, '$.k') || case when e.user_id % 50 = 0 then 'x' else '' end = f.k""")
def lookup_encode(spark, d):
    parts = split_events(spark, d).withColumn("k", F.get_json_object("props", "$.k"))
    train = parts.where("split = 'train'")
    freq = train.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    freq = freq.select("k", (F.col("n") / F.lit(train.count())).alias("f"))
    coded = parts.withColumn("k", F.concat("k", F.when(F.col("user_id") % 50 == 0, "x").otherwise("")))
    return compare.lookup_encode(coded, "k", freq, "k", "f", 0.0, "freq").select("event_id", "freq")


# ---- top slices -------------------------------------------------------------------------


@plan("top_fraction", "event_id:l score:d", f"""
  select event_id, score from {ranked_sql(SQL_EVENTS)} r where rank <= greatest(1, cast(ceil(n_rows * 0.02::double) as bigint))""")
def top_fraction(spark, d):
    return ranking.top_fraction(labelled_events(spark, d), "score", "event_id", 0.02).select("event_id", "score")


@plan("top_fraction_by_brackets", "event_id:l score:d", f"""
  select event_id, score from {ranked_sql(SQL_EVENTS)} r where rank <= greatest(1, cast(ceil(n_rows * 0.02::double) as bigint))""")
def top_fraction_by_brackets(spark, d):
    return ranking.top_fraction(labelled_events(spark, d), "score", "event_id", 0.02, direct_rows=0).select("event_id", "score")


@plan("score_at_top_fraction", "cutoff_score:d", f"""
  select min(score) as cutoff_score from {ranked_sql(SQL_EVENTS)} r where rank <= greatest(1, cast(ceil(n_rows * 0.05::double) as bigint))""")
def score_at_top_fraction(spark, d):
    return ranking.score_at_top_fraction(labelled_events(spark, d), "score", "event_id", 0.05)


@plan("top_per_group", "event_type:s event_id:l rank:l", """
  select event_type, event_id, rank from (select *, row_number() over (partition by event_type order by abs(value - 50) desc, event_id) as rank
  from events) r where rank <= 20""")
def top_per_group(spark, d):
    df = table(spark, d, "events").withColumn("deviation", F.col("value") - 50)
    return ranking.top_per_group(df, ["event_type"], "deviation", 20, "event_id").select("event_type", "event_id", "rank")


@plan("sample_n", "event_id:l value:d", """
  select event_id, value from events order by ('0x' || substr(md5('42:' || event_id), 1, 15))::bigint, event_id limit 5000""")
def sample_n(spark, d):
    return ranking.sample_n(table(spark, d, "events"), "event_id", 5000).select("event_id", "value")


# ---- curves and metrics --------------------------------------------------------------------

METRIC_COLUMNS = "n_rows:l n_positive:l average_precision:d roc_auc:d"


@plan("average_precision", "average_precision:d", f"select average_precision from {metrics_sql(SQL_EVENTS)} m")
def average_precision(spark, d):
    return ranking.average_precision(labelled_events(spark, d))


@plan("roc_auc", "roc_auc:d", f"select roc_auc from {metrics_sql(SQL_EVENTS)} m")
def roc_auc(spark, d):
    return ranking.roc_auc(labelled_events(spark, d))


@plan("ranking_metrics_by_split", f"split:s {METRIC_COLUMNS}", f"select * from {metrics_sql(SQL_SPLIT, 'split')} m")
def ranking_metrics_by_split(spark, d):
    return ranking.ranking_metrics(split_events(spark, d), by=["split"])


@plan("ranking_metrics_documents", f"lang:s {METRIC_COLUMNS}", f"select * from {metrics_sql(SQL_DOCUMENTS, 'lang')} m")
def ranking_metrics_documents(spark, d):
    return ranking.ranking_metrics(labelled_documents(spark, d), by=["lang"], strict=False)


@plan("pr_curve", "threshold:d precision:d recall:d", f"""
  select threshold, cp / cn::double as precision, cp / tp::double as recall from {curve_sql(SQL_EVENTS)} c
  union all select null, 1.0::double, 0.0::double""")
def pr_curve(spark, d):
    return ranking.pr_curve(labelled_events(spark, d))


@plan("roc_curve", "threshold:d fpr:d tpr:d", f"""
  select threshold, (cn - cp) / (tn - tp)::double as fpr, cp / tp::double as tpr from {curve_sql(SQL_EVENTS)} c
  union all select null, 0.0::double, 0.0::double""")
def roc_curve(spark, d):
    return ranking.roc_curve(labelled_events(spark, d))


THRESHOLDS = [0.05, 0.1, 0.2, 0.5, 0.9, 2.0]
CONFUSION_COLUMNS = "threshold:d tn:l fp:l fn:l tp:l precision:d recall:d f1:d fpr:d n_flagged:l"


def confusion_sql(src: str, thresholds, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""select {b}threshold, tn, fp, fn, tp, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision,
      coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) as f1,
      fp / nullif(fp + tn, 0)::double as fpr, tp + fp as n_flagged from (select {b}b as threshold,
      count(*) filter (score >= b and label = 1) as tp, count(*) filter (score >= b and label = 0) as fp,
      count(*) filter (score < b and label = 1) as fn, count(*) filter (score < b and label = 0) as tn
      from {src} s cross join ({values_sql(thresholds)}) t group by {b}b) c"""


@plan("threshold_metrics", CONFUSION_COLUMNS, confusion_sql(SQL_EVENTS, THRESHOLDS))
def threshold_metrics(spark, d):
    return ranking.threshold_metrics(labelled_events(spark, d), THRESHOLDS)


def best_f1_sql(src: str) -> str:
    return f"""(select threshold, f1 from (select threshold, case when cp > 0 then 2 * (cp / cn::double) * (cp / tp::double)
      / (cp / cn::double + cp / tp::double + 1e-12) else 0 end as f1 from {curve_sql(src)} c) x order by f1 desc, threshold limit 1)"""


@plan("best_f1_threshold", "threshold:d f1:d", f"select * from {best_f1_sql(SQL_EVENTS)} b")
def best_f1_threshold(spark, d):
    return ranking.best_f1_threshold(labelled_events(spark, d))


BUDGET_COLUMNS = "budget:d n_rows:l n_reviewed:l captured:l n_positive:l recall:d precision:d cutoff_score:d"


@plan("recall_at_k", "budget:d recall:d", f"select budget, recall from {budgets_sql(SQL_EVENTS, values_sql([0.02]))} t")
def recall_at_k(spark, d):
    return ranking.recall_at_k(labelled_events(spark, d), 0.02, **BY_EVENT)


@plan("precision_at_k", "budget:d precision:d", f"select budget, precision from {budgets_sql(SQL_EVENTS, values_sql([0.02]))} t")
def precision_at_k(spark, d):
    return ranking.precision_at_k(labelled_events(spark, d), 0.02, **BY_EVENT)


@plan("budget_table", f"split:s {BUDGET_COLUMNS}", f"select * from {budgets_sql(SQL_SPLIT, values_sql(ranking.BUDGETS), 'split')} t")
def budget_table(spark, d):
    return ranking.budget_table(split_events(spark, d), **BY_EVENT, by=["split"])


@plan("budget_curve", BUDGET_COLUMNS, f"select * from {budgets_sql(SQL_EVENTS, values_sql(ranking.budget_grid()), score='score_b')} t")
def budget_curve(spark, d):
    return ranking.budget_table(labelled_events(spark, d), ranking.budget_grid(), "score_b", "label", "event_id")


@plan("fixed_budget_report", "budget:d n_rows:l n_reviewed:l captured:l n_positive:l recall:d precision:d",
      f"select * from {budgets_sql(SQL_DOCUMENTS, values_sql([0.1]), id_col='doc_id')} t")
def fixed_budget_report(spark, d):
    return ranking.fixed_budget_report(labelled_documents(spark, d), 0.1, id_col="doc_id")


@plan("positive_rate_by_score_bin", "bin:l n_rows:l positive_rate:d", f"""
  select r.b as bin, coalesce(n, 0) as n_rows, positive_rate from (select unnest(range(20)) as b) r left join (
    select least(cast(floor(score * 20) as bigint), 19) as b, count(*) as n, avg(label) as positive_rate from {SQL_EVENTS} e group by 1) c using (b)""")
def positive_rate_by_score_bin(spark, d):
    return ranking.score_bins(labelled_events(spark, d))


@plan("score_histogram_by_decision", "decision:s bin:l n_rows:l positive_rate:d", f"""
  select {decide_sql('score', APPROVE_AT, BLOCK_AT)} as decision, least(cast(floor(score * 20) as bigint), 19) as bin, count(*) as n_rows,
    avg(label) as positive_rate from {SQL_EVENTS} e group by 1, 2""")
def score_histogram_by_decision(spark, d):
    return ranking.score_bins(rows.decided(labelled_events(spark, d), "score", APPROVE_AT, BLOCK_AT), by=["decision"])


@plan("score_correlation", "n:l pearson_r:d spearman_rho:d", f"""
  select count(*) as n, corr(score, score_b) as pearson_r, corr(ra, rb) as spearman_rho from (select score, score_b,
    rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as ra,
    rank() over (order by score_b) + (count(*) over (partition by score_b) - 1) / 2.0::double as rb from {SQL_EVENTS} e) x""")
def score_correlation(spark, d):
    return ranking.score_correlation(labelled_events(spark, d), "score", "score_b").drop("pearson_p", "spearman_p")


@plan("score_correlation_p_values", "n:l in_range:b near_normal:b", "select count(*) as n, true as in_range, true as near_normal from events")
def score_correlation_p_values(spark, d):
    """With this many rows the t distribution is the normal one to three digits."""
    got = ranking.score_correlation(labelled_events(spark, d), "score", "score_b")
    import math
    r = got.first()
    normal = lambda c: math.erfc(abs(c) * math.sqrt((r["n"] - 2) / (1 - c * c)) / math.sqrt(2))
    near = all(abs(normal(r[c]) - r[p]) < 1e-3 for c, p in (("pearson_r", "pearson_p"), ("spearman_rho", "spearman_p")))
    inside = F.col("pearson_p").between(0, 1) & F.col("spearman_p").between(0, 1)
    return got.select("n", inside.alias("in_range"), F.lit(near).alias("near_normal"))


# ---- overlap ------------------------------------------------------------------------------------


def flags_sql(src: str, k: float) -> str:
    n = f"greatest(1, cast(ceil(count(*) over () * {k}::double) as bigint))"
    return f"""(select label, row_number() over (order by score desc, event_id desc) <= {n} as a,
      row_number() over (order by score_b desc, event_id desc) <= {n} as b from {src} f0)"""


@plan("topk_overlap", "n_each:l n_both:l n_only_a:l n_only_b:l pos_a:l pos_b:l pos_both:l pos_only_a:l pos_only_b:l n_positive:l overlap_share:d", f"""
  select count(*) filter (a) as n_each, count(*) filter (a and b) as n_both, count(*) filter (a and not b) as n_only_a,
    count(*) filter (b and not a) as n_only_b, count(*) filter (a and label = 1) as pos_a, count(*) filter (b and label = 1) as pos_b,
    count(*) filter (a and b and label = 1) as pos_both, count(*) filter (a and not b and label = 1) as pos_only_a,
    count(*) filter (b and not a and label = 1) as pos_only_b, count(*) filter (label = 1) as n_positive,
    count(*) filter (a and b) / count(*) filter (a)::double as overlap_share from {flags_sql(SQL_EVENTS, 0.05)} f""")
def topk_overlap(spark, d):
    return compare.topk_overlap(labelled_events(spark, d), "score", "score_b", 0.05, id_col="event_id")


@plan("topk_union", "n_union:l effective_budget:d pos_union:l recall_union:d pos_a:l gain_over_a:l", f"""
  select n_union, n_union / n::double as effective_budget, pos_union, pos_union / p::double as recall_union, pos_a, pos_union - pos_a as gain_over_a
  from (select count(*) as n, count(*) filter (a or b) as n_union, count(*) filter ((a or b) and label = 1) as pos_union,
    count(*) filter (a and label = 1) as pos_a, sum(label) as p from {flags_sql(SQL_EVENTS, 0.05)} f) x""")
def topk_union(spark, d):
    return compare.topk_union(labelled_events(spark, d), "score", "score_b", 0.05, id_col="event_id")


# ---- policies -------------------------------------------------------------------------------------


def policy_sql(src: str, approve=APPROVE_AT, block=BLOCK_AT, by: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f"group by {by}" if by else ""
    cells = ", ".join(f"count(*) filter (dec = '{x}') as n_{x.lower()}, count(*) filter (dec = '{x}' and label = 1) as pos_{x.lower()}"
                      for x in ("APPROVE", "REVIEW", "BLOCK"))
    return f"""(select *, pos_review + pos_block as captured, (pos_review + pos_block) / nullif(n_positive, 0)::double as recall_review_block,
      pos_review / nullif(n_review, 0)::double as precision_review, pos_block / nullif(n_block, 0)::double as precision_block,
      (n_review - pos_review) / nullif(n_rows - n_positive, 0)::double as share_negatives_reviewed,
      (n_block - pos_block) / nullif(n_rows - n_positive, 0)::double as share_negatives_blocked,
      (n_review - pos_review + n_block - pos_block) / nullif(n_rows - n_positive, 0)::double as share_negatives_touched
      from (select {b}count(*) as n_rows, sum(label) as n_positive, {cells} from (select *, {decide_sql('score', approve, block)} as dec
      from {src} p0) p1 {g}) p2)"""


SUMMARY_COLUMNS = ("n_rows:l n_positive:l n_approve:l pos_approve:l n_review:l pos_review:l n_block:l pos_block:l captured:l "
                   "recall_review_block:d precision_review:d precision_block:d share_negatives_reviewed:d "
                   "share_negatives_blocked:d share_negatives_touched:d")
REPORT_COLUMNS = "decision:s n:l share:d positives:l negatives:l positive_rate:d"
REPORT_SQL = f"""select v.decision, count(x.label) as n, count(x.label) / (select count(*) from {SQL_EVENTS} c)::double as share,
  coalesce(sum(label), 0) as positives, count(x.label) - coalesce(sum(label), 0) as negatives, avg(label) as positive_rate
  from (values ('APPROVE'), ('REVIEW'), ('BLOCK')) v(decision) left join (select label, {decide_sql('score', APPROVE_AT, BLOCK_AT)} as decision
  from {SQL_EVENTS} e) x on x.decision = v.decision group by v.decision"""


@plan("policy_summary", f"split:s {SUMMARY_COLUMNS}", f"select * from {policy_sql(SQL_SPLIT, by='split')} p")
def policy_summary(spark, d):
    return policy.policy_summary(split_events(spark, d), approve=APPROVE_AT, block=BLOCK_AT, by=["split"])


@plan("policy_report", REPORT_COLUMNS, REPORT_SQL)
def policy_report(spark, d):
    return policy.policy_report(labelled_events(spark, d), approve=APPROVE_AT, block=BLOCK_AT)


def grid_sql(step: float, count: int) -> str:
    return f"select {step}::double + (i - 1) * {step}::double as b from (select unnest(range(1, {count + 1})) as i) g"


GRID = policy.scan_grid(0.02, 0.0005)
SQL_VAL = f"(select * from {SQL_SPLIT} v0 where split = 'val')"


def scan_sql(src: str, capacity: float, target: float, step: float = 0.0005) -> str:
    grid = grid_sql(step, len(policy.scan_grid(capacity, step)))
    return f"""(select budget as block_fraction, precision as achieved_precision, precision >= {target} as target_achieved,
      cutoff_score as block_threshold from {budgets_sql(src, grid)} t
      order by (precision >= {target}) desc, case when precision >= {target} then -budget else budget end limit 1)"""


@plan("block_fraction_scan", "block_fraction:d achieved_precision:d target_achieved:b block_threshold:d",
      f"select * from {scan_sql(SQL_EVENTS, 0.02, 0.22)} s")
def block_fraction_scan(spark, d):
    return policy.block_fraction_scan(labelled_events(spark, d), 0.02, 0.22, **BY_EVENT)


CANDIDATES = [("conservative", 0.01, 0.9), ("balanced", 0.02, 0.3), ("strict", 0.05, 0.2)]


def derive_sql(src: str) -> str:
    return " union all ".join(f"""select '{n}' as policy, {c}::double as review_capacity, {t}::double as block_precision_target,
      (select min(cutoff_score) from {budgets_sql(src, values_sql([c]))} a) as approve_threshold, block_threshold, block_fraction,
      achieved_precision as block_precision, target_achieved from {scan_sql(src, c, t)} s{i}""" for i, (n, c, t) in enumerate(CANDIDATES))


@plan("derive_policies", "policy:s review_capacity:d block_precision_target:d approve_threshold:d block_threshold:d block_fraction:d "
      "block_precision:d target_achieved:b", derive_sql(SQL_VAL))
def derive_policies(spark, d):
    return policy.derive_policies(split_events(spark, d).where("split = 'val'"), CANDIDATES, **BY_EVENT)


@plan("policy_vs_budget", "matched_fraction:d n_intervened:l policy_captured:l policy_recall:d precision_block:d precision_review:d "
      "budget_reviewed:l budget_captured:l budget_recall:d recall_delta:d", f"""
  select f as matched_fraction, n_review + n_block as n_intervened, captured as policy_captured, recall_review_block as policy_recall,
    precision_block, precision_review, rank as budget_reviewed, cum_y as budget_captured, cum_y / p.n_positive::double as budget_recall,
    recall_review_block - cum_y / p.n_positive::double as recall_delta
  from (select *, n_review / n_rows::double + n_block / n_rows::double as f from {policy_sql(SQL_EVENTS)} q) p
  join {ranked_sql(SQL_EVENTS)} r on r.rank = greatest(1, cast(ceil(p.n_rows * f) as bigint))""")
def policy_vs_budget(spark, d):
    return policy.policy_vs_budget(labelled_events(spark, d), DecisionPolicy(APPROVE_AT, BLOCK_AT), **BY_EVENT)


# ---- reports over splits and models -----------------------------------------------------------------

REPORT_THRESHOLD = 0.2
SPLIT_REPORT_SQL = f"""
  with m as (select * from {metrics_sql(SQL_SPLIT, 'split')} a), c as ({confusion_sql(SQL_SPLIT, [REPORT_THRESHOLD], 'split')}),
  k as (select * from {budgets_sql(SQL_SPLIT, values_sql(ranking.BUDGETS), 'split')} b)
  select split, 'average_precision' as metric, average_precision as value from m union all select split, 'roc_auc', roc_auc from m
  {' '.join(f"union all select split, '{x}', {x}::double from c" for x in ('tn', 'fp', 'fn', 'tp', 'precision', 'recall', 'f1', 'fpr'))}
  union all select split, 'recall_at_' || printf('%.4f', budget), recall from k
  union all select split, 'precision_at_' || printf('%.4f', budget), precision from k"""


@plan("split_report", "split:s metric:s value:d", SPLIT_REPORT_SQL)
def split_report(spark, d):
    return compare.split_report(split_events(spark, d), ["split"], REPORT_THRESHOLD, id_col="event_id")


def _models(df, val_only=True):
    """Several candidate scores of the same rows as one long table."""
    base = df.where("split = 'val'") if val_only else df
    scores = {"champion": F.col("score"), "random": F.col("score_b"), "reverse": 1.0 - F.col("score"),
              "rounded": F.round("score", 1)}
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("model_id"), c.alias("score"))
                      for i, (n, c) in enumerate(scores.items())])
    return base.select("event_id", "label", F.explode(cells).alias("m")).select("event_id", "label", "m.*")


SQL_MODELS = f"""(select event_id, label, v.* from {SQL_VAL} e, lateral (values (0, 'champion', score), (1, 'random', score_b),
  (2, 'reverse', 1.0 - score), (3, 'rounded', round(score, 1))) v(position, model_id, score))"""


@plan("select_by_validation", "selected:s average_precision:d", f"""
  select model_id as selected, average_precision from {metrics_sql(SQL_MODELS, 'position, model_id')} m
  order by average_precision desc, position limit 1""")
def select_by_validation(spark, d):
    metrics = ranking.ranking_metrics(_models(split_events(spark, d)), by=["position", "model_id"])
    return compare.select_by_validation(metrics, "model_id", "position")


@plan("metric_reproducibility", "split:s metric:s stored:d recomputed:d abs_diff:d reproduced:b", f"""
  with r as ({SPLIT_REPORT_SQL}) select split, metric, s as stored, value as recomputed, abs(s - value) as abs_diff, abs(s - value) <= 1e-9 as reproduced
  from (select *, case when metric = 'f1' then value + 0.001 else value end as s from r) x""")
def metric_reproducibility(spark, d):
    report = split_report(spark, d)
    stored = report.withColumn("value", F.when(F.col("metric") == "f1", F.col("value") + 0.001).otherwise(F.col("value")))
    return compare.metric_reproducibility(stored, report, ["split", "metric"])


def compare_sql() -> str:
    return f"""(with own as (select m.model_id, average_precision, roc_auc, recall_review_block, precision_block, share_negatives_blocked,
      n_approve / p.n_rows::double as share_approve, n_review / p.n_rows::double as share_review, n_block / p.n_rows::double as share_block
      from {metrics_sql(SQL_MODELS, 'model_id')} m join {policy_sql(SQL_MODELS, by='model_id')} p on m.model_id = p.model_id)
    select a.*, {', '.join(f'c.{x} as champion_{x}' for x in COMPARED)}, a.average_precision - c.average_precision as delta_ap,
      a.roc_auc - c.roc_auc as delta_roc_auc, a.recall_review_block - c.recall_review_block as delta_recall,
      a.precision_block - c.precision_block as delta_block_precision,
      a.share_negatives_blocked - c.share_negatives_blocked as delta_negatives_blocked
    from own a cross join own c where a.model_id <> 'champion' and c.model_id = 'champion')"""


COMPARED = ["average_precision", "roc_auc", "recall_review_block", "precision_block", "share_negatives_blocked"]


@plan("compare_models", "model_id:s " + " ".join(f"{c}:d" for c in [*COMPARED, "share_approve", "share_review", "share_block",
      *[f"champion_{x}" for x in COMPARED], "delta_ap", "delta_roc_auc", "delta_recall", "delta_block_precision",
      "delta_negatives_blocked"]), f"select * from {compare_sql()} c")
def compare_models(spark, d):
    return compare.compare_models(_models(split_events(spark, d)), "champion", APPROVE_AT, BLOCK_AT)


@plan("promotion_gates", "model_id:s passed_gates:s review_gates:s failed_gates:s recommendation:s", f"""
  with g as (select model_id, unnest([
      struct_pack(o := 1, g := 'metrics_known', r := case when average_precision is not null and roc_auc is not null then 'PASS' else 'FAIL' end),
      struct_pack(o := 2, g := 'same_schema', r := case when model_id <> 'reverse' then 'PASS' else 'FAIL' end),
      struct_pack(o := 3, g := 'precision_floor', r := case when average_precision >= 0.30 then 'PASS' else 'FAIL' end),
      struct_pack(o := 4, g := 'precision_held', r := case when delta_ap >= -0.005 - 1e-9 then 'PASS'
        when delta_ap >= -0.02 - 1e-9 then 'REQUIRES_REVIEW' else 'FAIL' end),
      struct_pack(o := 5, g := 'blocking_held', r := case when delta_negatives_blocked <= 0.005 then 'PASS' else 'REQUIRES_REVIEW' end),
      struct_pack(o := 6, g := 'same_policy', r := case when model_id <> 'rounded' then 'PASS' else 'REQUIRES_REVIEW' end)]) as s
    from {compare_sql()} c)
  select model_id, {', '.join(f"coalesce(string_agg(s.g, ',' order by s.o) filter (s.r = '{r}'), '') as {n}"
                             for r, n in (('PASS', 'passed_gates'), ('REQUIRES_REVIEW', 'review_gates'), ('FAIL', 'failed_gates')))},
    case when bool_or(s.r = 'FAIL') then 'REJECT' when bool_or(s.r = 'REQUIRES_REVIEW') then 'REQUIRES_REVIEW' else 'PROMOTE' end as recommendation
  from g group by model_id""")
def promotion_gates(spark, d):
    models = _models(split_events(spark, d))
    comparison = compare.compare_models(models, "champion", APPROVE_AT, BLOCK_AT)
    metadata = models.select("model_id").distinct().select(
        "model_id", F.when(F.col("model_id") == "reverse", "s2").otherwise("s1").alias("schema_version"),
        F.when(F.col("model_id") == "rounded", "p2").otherwise("p1").alias("policy_version"))
    return compare.promotion_gates(comparison, metadata, "champion")
