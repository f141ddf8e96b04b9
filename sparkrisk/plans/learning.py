"""Model plans (M1-M10): later rows are scored by what was fitted on earlier ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import materialized
from ..ml import forest, models, prep, trees
from ..operators import history, policy, ranking
from ..operators.split import temporal_split
from .bindings import (EVENTS, SQL_DOCUMENTS, SQL_EVENTS, SQL_GAPS, history_sql, labelled_documents, labelled_events, metrics_sql, split_sql, table,
                       with_gaps)
from .registry import plan

NUMERIC = ["value", "k", "hour", *history.feature_names()]
SQL_GAPPY_SPLIT = split_sql(SQL_GAPS)


def model_table(spark, d):
    """Events with history features, a noisy label and the split; kept because fitting rereads it."""
    df = labelled_events(spark, d)
    feats = history.history_features(df, EVENTS, keep=["ts", "value", "props", "score_b", "event_type"]).withColumns({
        "k": F.get_json_object("props", "$.k").cast("double"), "hour": F.hour("ts").cast("double")})
    # a learnable label: amounts far above the entity's own history, with noise
    odds = F.coalesce(F.col("bhv_amt_zscore"), F.lit(0.0)) - 1.5 + F.col("value") / 100.0
    # two categories: one with a value that no train row has, one with values missing
    feats = feats.withColumns({"kind": F.when(F.col("event_id") % 9 != 4, F.col("event_type")), "k_text": F.col("k").cast("int").cast("string")})
    feats = feats.withColumn("label", (F.col("score_b") < 1.0 / (1.0 + F.exp(-odds))).cast("int"))
    return materialized(temporal_split(feats.drop("props"), EVENTS))


def _part(df, name):
    return df.where(F.col("split") == name)


def _gappy_split(spark, d):
    return temporal_split(with_gaps(labelled_events(spark, d)), EVENTS)


@plan("linear_prep", "feature:s median:d mean:d std:d", " union all ".join(f"""
  select '{c}' as feature, m as median, avg(coalesce({c}, m)) as mean, stddev_pop(coalesce({c}, m)) as std
  from (select * from {SQL_GAPPY_SPLIT} s where split = 'train') a cross join (select quantile_cont({c}, 0.5) as m
    from {SQL_GAPPY_SPLIT} q where split = 'train') b group by m""" for c in ("value", "user_id")))
def linear_prep(spark, d):
    return prep.fit_scaling(_part(_gappy_split(spark, d), "train"), ["value", "user_id"])


@plan("linear_features", "event_id:l value_z:d n_hot:l", f"""
  with m as (select quantile_cont(value, 0.5) as med from {SQL_GAPPY_SPLIT} q where split = 'train'),
  s as (select avg(coalesce(value, med)) as mu, stddev_pop(coalesce(value, med)) as sd from {SQL_GAPPY_SPLIT} q cross join m where split = 'train')
  select event_id, (coalesce(value, med) - mu) / sd as value_z, case when event_type is null then 0 else 1 end as n_hot
  from {SQL_GAPPY_SPLIT} e cross join m cross join s""")
def linear_features(spark, d):
    """All rows through the fitted pipeline; a missing type is an all-zero one-hot block."""
    df = _gappy_split(spark, d)
    fitted = prep.linear_prep(_part(df, "train"), ["value"], ["event_type"])
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array("features")
    return fitted.transform(df).select("event_id", x[0].alias("value_z"), F.aggregate(
        F.slice(x, 2, F.size(x) - 1), F.lit(0.0), lambda s, v: s + v).cast("int").alias("n_hot"))


@plan("tree_prep", "feature:s category:s code:l", f"""
  with t as (select * from {SQL_GAPPY_SPLIT} s where split = 'train'),
  v as (select 'event_type' as feature, event_type as category from t union select 'props', props from t),
  c as (select feature, category, row_number() over (partition by feature order by category) - 1 as code from v where category is not null)
  select * from c union all select feature, '__missing__', count(*) from c group by feature
  union all select feature, '__unseen__', count(*) + 1 from c group by feature""".replace(", props from t", ", json_extract_string(props, '$.k') from t")
  .replace(SQL_GAPPY_SPLIT, split_sql(SQL_GAPS.replace("select event_id,", "select props, event_id,"))))
def tree_prep(spark, d):
    df = _gappy_split(spark, d).withColumn("props", F.get_json_object("props", "$.k"))
    return prep.category_vocabulary(_part(df, "train"), ["event_type", "props"])


@plan("anomaly_prep", "event_id:l value:d event_type_freq:d", f"""
  with t as (select *, coalesce(event_type, '__missing__') as c from {SQL_GAPPY_SPLIT} s), tr as (select * from t where split = 'train')
  select event_id, coalesce(value, (select quantile_cont(value, 0.5) from tr)) as value,
    coalesce(n / (select count(*) from tr)::double, 0) as event_type_freq
  from t left join (select c, count(*) as n from tr group by c) f using (c)""")
def anomaly_prep(spark, d):
    df = _gappy_split(spark, d)
    return prep.anomaly_prep(df, _part(df, "train"), ["value"], ["event_type"], keep=["event_id"])


@plan("tree_features", "event_id:l kind_code:l k_code:l", f"""
  with e as (select event_id, split, case when split <> 'train' and event_id % 50 = 0 then 'new' else event_type end as kind, json_extract_string(props, '$.k') as k
    from {split_sql(SQL_GAPS.replace("select event_id,", "select props, event_id,"))} s),
  v as (select kind, row_number() over (order by kind) - 1 as code, count(*) over () as n from (select distinct kind from e where split = 'train' and kind is not null) q),
  w as (select k, row_number() over (order by k) - 1 as code, count(*) over () as n from (select distinct k from e where split = 'train' and k is not null) q)
  select event_id, case when kind is null then (select max(n) from v) else coalesce(v.code, (select max(n) + 1 from v)) end as kind_code,
    case when e.k is null then (select max(n) from w) else coalesce(w.code, (select max(n) + 1 from w)) end as k_code
  from e left join v using (kind) left join w on w.k = e.k""")
def tree_features(spark, d):
    """Encoded rows as the trees see them: codes in sorted order, one for missing, one for unseen."""
    df = _gappy_split(spark, d).withColumns({"k": F.get_json_object("props", "$.k"), "kind": F.when(
        (F.col("split") != "train") & (F.col("event_id") % 50 == 0), "new").otherwise(F.col("event_type"))})
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array("features")
    return prep.tree_prep(_part(df, "train"), ["value"], ["kind", "k"]).transform(df).select(
        "event_id", x[2].cast("long").alias("kind_code"), x[3].cast("long").alias("k_code"))


CATEGORIES = ["kind", "k_text"]


SQL_LABELLED = f"""(select event_id, split, (score_b < 1.0 / (1.0 + exp(-(coalesce(bhv_amt_zscore, 0) - 1.5 + value / 100.0::double))))::int as label
  from {split_sql(f"(select h.* from {history_sql(SQL_EVENTS, 'event_id', 'user_id', 'value', 't, value, score_b')} h)")} s)"""


@plan("train_logistic", "split:s n_rows:l n_positive:l average_precision:d roc_auc:d", f"""
  with e as (select x.*, (value >= 40)::double as large from {SQL_LABELLED} x join events using (event_id)),
  m as (select large, avg(label) as rate from e where split = 'train' group by large),
  r as (select split, label, rate as score from e join m using (large) where split <> 'train')
  select split, n_rows, n_positive, average_precision, roc_auc from {metrics_sql("r", "split")} q""")
def train_logistic(spark, d):
    """Calibrated model of one 0/1 column: calibration keeps the order, so its metrics are those of the two groups' rates."""
    df = model_table(spark, d).withColumn("large", (F.col("value") >= 40).cast("double"))
    ready = prep.linear_prep(_part(df, "train"), ["large"], []).transform(df).select("event_id", "label", "split", "features")
    model = models.train_logistic(_part(ready, "train"), "event_id", balanced=True)
    scored = models.score_rows(model, ready.where("split <> 'train'")).withColumn("score", F.round("score", 9))
    return ranking.ranking_metrics(scored, by=["split"])


DOC_PARTS = "doc_id % 10 >= 7"


@plan("train_logistic_documents", "doc_id:l label:l probability:d", f"""
  with d as (select * from {SQL_DOCUMENTS} d0), m as (select lang, avg(label) as p from d where not ({DOC_PARTS}) group by lang)
  select doc_id, label, p as probability from d join m on d.lang is not distinct from m.lang where {DOC_PARTS}""", digits=4)
def train_logistic_documents(spark, d):
    """Fitted on seven tenths of the documents; the others are scored. With a category as its only input, a fit without a
    penalty gives each language its own rate."""
    df = labelled_documents(spark, d)
    learn, rest = df.where(f"not ({DOC_PARTS})"), df.where(DOC_PARTS)
    rest = rest.join(learn.select("lang").distinct().withColumnRenamed("lang", "known"), F.col("lang").eqNullSafe(F.col("known"))).drop("known")
    fitted = prep.linear_prep(learn, [], ["lang"])
    ready = lambda x: fitted.transform(x).select("doc_id", "label", "features")
    model = models.train_logistic(ready(learn), "doc_id", reg=0.0, max_iter=300, tol=1e-12)
    from pyspark.ml.functions import vector_to_array
    return model.stages[0].transform(ready(rest)).select("doc_id", "label", vector_to_array("p_raw")[1].alias("probability"))


@plan("explain_linear", "event_id:l margin:d base_value:d feature:s contribution:d", f"""
  with e as (select x.*, (value >= 40)::double as large from {SQL_LABELLED} x join events using (event_id)),
  m as (select avg(label) filter (large = 1) as p1, avg(label) filter (large = 0) as p0, avg(large) as mu from e where split = 'train'),
  c as (select ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) as coef, ln(p0 / (1 - p0)) as intercept, mu from m)
  select event_id, intercept + coef * large as margin, intercept + coef * mu as base_value, 'large' as feature, coef * (large - mu) as contribution from e cross join c""", digits=4)
def explain_linear(spark, d):
    """One 0/1 column: its coefficient is the difference of the groups' log odds."""
    df = model_table(spark, d).withColumn("large", (F.col("value") >= 40).cast("double"))
    ready = prep.linear_prep(_part(df, "train"), ["large"], []).transform(df).select("event_id", "label", "split", "features")
    model = models.train_logistic(_part(ready, "train"), "event_id", reg=0.0, max_iter=300, tol=1e-12).stages[0]
    out = models.explain_linear(model, ready, _part(ready, "train"), ["large"], ["event_id"])
    return out.select("event_id", "margin", "base_value", F.explode("contributions").alias("c")).select("event_id", "margin", "base_value", "c.*")


# ---- boosting: a few rounds of two leaves, which SQL can follow -------------------------------------------------

STUMPS = dict(rounds=3, leaves=2, feature_share=1.0, row_share=1.0)
STUMP_NUMERIC, STUMP_CATEGORICAL = ["band", "hour"], ["kind"]


def log_likelihood(staged):
    """A metric of the caller's, which rises with every useful round: the mean log likelihood."""
    right = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    return staged.groupBy("stage").agg(F.avg(F.log(right)).alias("value"))


def _stumps(spark, d, metric=log_likelihood):
    df = model_table(spark, d).withColumn("band", F.when(F.col("event_id") % 11 != 3, F.floor(F.col("value") / 25)))
    return df, models.train_boosted_trees(_part(df, "train"), _part(df, "val"), "event_id", STUMP_NUMERIC, STUMP_CATEGORICAL, patience=99, metric=metric, **STUMPS)


def stumps_sql(rounds: int = 3) -> str:
    """Common tables: margins ``m0``, ``m1``, … of all rows, the best split ``best1``, … of each round, ``start``."""
    pull = lambda g: f"(sign({g}) * greatest(abs({g}) - 0.1, 0))"
    worth = lambda g, h: f"({pull(g)} ** 2 / ({h} + 0.1))"
    out = [f"""rows as materialized (select x.event_id, x.split, x.label, case when x.event_id % 11 <> 3 then floor(value / 25) end as band,
      hour(ts)::double as hour, case when x.event_id % 9 <> 4 then event_type end as kind from {SQL_LABELLED} x join events using (event_id))""",
           "start as (select ln(avg(label) / (1 - avg(label))) as s from rows where split = 'train')",
           "m0 as materialized (select rows.*, s as margin from rows cross join start)"]
    for r in range(1, rounds + 1):
        out += [f"x{r} as materialized (select *, 1 / (1 + exp(-margin)) as q from m{r - 1} where split = 'train')",
                f"tot{r} as (select sum(q - label) as g, sum(q * (1 - q)) as h, count(*) as n from x{r})",
                f"""sums{r} as (select 0 as f, band as v, null as c, sum(q - label) as g, sum(q * (1 - q)) as h, count(*) as n from x{r} group by band
      union all select 1, hour, null, sum(q - label), sum(q * (1 - q)), count(*) from x{r} group by hour
      union all select 2, null, kind, sum(q - label), sum(q * (1 - q)), count(*) from x{r} group by kind)""",
                f"cat{r} as (select *, row_number() over (order by g / (h + 10), c nulls first) as rk from sums{r} where f = 2)",
                f"""cum{r} as (select f, v as place, sum(g) over w as g, sum(h) over w as h, sum(n) over w as n from sums{r} where f < 2 and v is not null window w as (partition by f order by v)
      union all select f, rk, sum(g) over w, sum(h) over w, sum(n) over w from cat{r} window w as (order by rk))""",
                f"""cand{r} as (select f, place, 0 as ml, g, h, n from cum{r} union all
      select a.f, place, 1, a.g + b.g, a.h + b.h, a.n + b.n from cum{r} a join sums{r} b on a.f = b.f and a.f < 2 and b.v is null)""",
                f"""best{r} as materialized (select {r} as round, c.*, t.n as all_n, {worth("c.g", "c.h")} + {worth("(t.g - c.g)", "(t.h - c.h)")} - {worth("t.g", "t.h")} as gain,
      -{pull("c.g")} / (c.h + 0.1) * 0.05 as lv, -{pull("(t.g - c.g)")} / (t.h - c.h + 0.1) * 0.05 as rv,
      case when exists (select 1 from sums{r} z where z.f = c.f and z.v is null) then c.ml = 1 else c.n > t.n - c.n end as missing_left,
      (select list(c order by c) from cat{r} z where c.f = 2 and z.rk <= c.place and z.c is not null) as cats, (select count(*) from cat{r} z where c.f = 2 and z.rk <= c.place and z.c is null) as none_left
      from cand{r} c cross join tot{r} t where least(c.n, t.n - c.n) >= 50 and least(c.h, t.h - c.h) >= 0.001 order by gain desc, f, ml, place limit 1)""",
                f"""m{r} as materialized (select m.* exclude (margin), margin + case when case f when 0 then case when band is null then missing_left else band <= place end
      when 1 then case when hour is null then missing_left else hour <= place end
      else case when kind is null then none_left > 0 else list_contains(cats, kind) end end then lv else rv end as margin from m{r - 1} m cross join best{r})"""]
    splits = " union all ".join(f"select * from best{r}" for r in range(1, rounds + 1))
    out.append(f"splits as (select *, (['band', 'hour', 'kind'])[f + 1] as feature from ({splits}) u)")
    return ", ".join(out)


SQL_STUMPS = stumps_sql()
SQL_HIST = "hist as (" + " union all ".join(
    f"select {r} as stage, avg(ln(case when label = 1 then 1 / (1 + exp(-margin)) else 1 - 1 / (1 + exp(-margin)) end)) as value from m{r} where split = 'val'" for r in (1, 2, 3)) + ")"
SQL_AP = "hist as (" + " union all ".join(
    f"select {r} as stage, average_precision as value from " + metrics_sql(f"(select label, 1 / (1 + exp(-margin)) as score from m{r} where split = 'val')") + f" q{r}" for r in (1, 2, 3)) + ")"


@plan("boosted_splits", "round:l feature:s threshold:d missing_left:b categories:s gain:d left_value:d right_value:d left_rows:l", f"""
  with {SQL_STUMPS}, {SQL_HIST}, chosen as (select min(stage) as last from hist where value = (select max(value) from hist))
  select round, feature, case when f < 2 then place end as threshold, case when f < 2 then missing_left else none_left > 0 end as missing_left,
    case when f = 2 then array_to_string(cats, ',') end as categories, gain, lv as left_value, rv as right_value, n as left_rows from splits where round <= (select last from chosen)""")
def boosted_splits(spark, d):
    """Best split of each round over all cut points, both ways for missing values, and all category subsets in order."""
    nodes = _stumps(spark, d)[1].node_table(spark)
    root = nodes.where("node = 0")
    value = lambda side: nodes.select(F.col("tree"), F.col("node").alias(side), F.col("value").alias(f"{side}_value"), F.col("cover").alias(f"{side}_rows"))
    both = root.drop("value").join(value("left"), ["tree", "left"]).join(value("right"), ["tree", "right"])
    return both.select((F.col("tree") + 1).alias("round"), "feature", "threshold", "missing_left", F.array_join("categories", ",").alias("categories"), "gain",
                       "left_value", "right_value", F.col("left_rows").cast("long").alias("left_rows"))


@plan("train_boosted_trees", "stage:l value:d chosen:b", f"""
  with {SQL_STUMPS}, {SQL_AP} select stage, value, stage = (select min(stage) from hist where value = (select max(value) from hist)) as chosen from hist""")
def train_boosted_trees(spark, d):
    """Validation average precision after every round, and the round that is kept."""
    return _stumps(spark, d, None)[1].history


CHOSEN = "(select min(stage) from hist where value = (select max(value) from hist))"


@plan("feature_importance", "feature:s gain:d importance:d rank:l", f"""
  with {SQL_STUMPS}, {SQL_HIST}, g as (select feature, sum(gain) as gain from splits where round <= {CHOSEN} group by feature),
  every as (select unnest(['band', 'hour', 'kind']) as feature), z as (select feature, coalesce(gain, 0) as gain from every left join g using (feature))
  select feature, gain, gain / sum(gain) over () as importance, row_number() over (order by gain desc, feature) as rank from z""")
def feature_importance(spark, d):
    return models.feature_importance(spark, _stumps(spark, d)[1])


SQL_MARGIN = "(select * from (" + " union all ".join(f"select {r} as stage, * from m{r}" for r in (1, 2, 3)) + f") u where stage = {CHOSEN})"


@plan("score_rows", "event_id:l split:s label:l score:d", f"""
  with {SQL_STUMPS}, {SQL_HIST} select event_id, split, label, 1 / (1 + exp(-margin)) as score from {SQL_MARGIN} q""")
def score_rows(spark, d):
    df, made = _stumps(spark, d)
    return made.score(df, ["event_id", "split", "label"])


SQL_PHI = f"""phi as (select event_id, feature, sum(case when went = lv then lv else rv end - (n * lv + (all_n - n) * rv) / all_n) as contribution from (
    """ + " union all ".join(f"select a.event_id, s.feature, b.margin - a.margin as step, case when abs(b.margin - a.margin - lv) < abs(b.margin - a.margin - rv) then lv else rv end as went, s.lv, s.rv, s.n, s.all_n, s.round from m{r - 1} a join m{r} b using (event_id) join splits s on s.round = {r}" for r in (1, 2, 3)) + f""") u
    where round <= {CHOSEN} group by event_id, feature),
  every as (select event_id, unnest(['band', 'hour', 'kind']) as feature from rows),
  placed as (select event_id, feature, coalesce(contribution, 0) as contribution, row_number() over (partition by event_id order by round(abs(coalesce(contribution, 0)), 12) desc, feature) - 1 as position
    from every left join phi using (event_id, feature))"""


@plan("explain_scores", "event_id:l margin:d base_value:d position:l feature:s contribution:d", f"""
  with {SQL_STUMPS}, {SQL_HIST}, {SQL_PHI}, base as (select s + sum((n * lv + (all_n - n) * rv) / all_n) as base_value from start cross join splits where round <= {CHOSEN} group by s)
  select event_id, margin, base_value, position, feature, contribution from placed join {SQL_MARGIN} q using (event_id) cross join base""")
def explain_scores(spark, d):
    """Margin, base value and every feature's contribution of every row, in order of size."""
    df, made = _stumps(spark, d)
    out = trees.shap_contributions(df, made, ["event_id"])
    return out.select("event_id", "margin", "base_value", F.posexplode("contributions").alias("position", "c")).select("event_id", "margin", "base_value", "position", "c.*")


@plan("top_contributors", "event_id:l position:l feature:s contribution:d", f"""
  with {SQL_STUMPS}, {SQL_HIST}, {SQL_PHI} select event_id, position, feature, contribution from placed where position < 2""")
def top_contributors(spark, d):
    """The two largest contributions of a row."""
    df, made = _stumps(spark, d)
    rows = trees.shap_contributions(df, made, ["event_id"], top=2)
    return rows.select("event_id", F.posexplode("contributions").alias("position", "c")).select("event_id", "position", "c.*")


@plan("isolation_forest", "vec_id:l", "select vec_id from embeddings where vec_id % 50 = 0")
def isolation_forest(spark, d):
    """Every fiftieth vector is moved far out; those with the highest scores, as many as were moved, are the ones."""
    moved = F.col("vec_id") % 50 == 0
    df = table(spark, d, "embeddings").withColumn("embedding", F.when(moved, F.transform("embedding", lambda x: x.cast("double") * 25.0)).otherwise(F.col("embedding").cast("array<double>")))
    grown = materialized(forest.train_isolation_forest(df, "vec_id", "embedding", n_trees=100, feature_share=0.5))
    scored = materialized(forest.anomaly_score(df, grown, ["vec_id"], "embedding"))
    return ranking.top_fraction(scored, "anomaly_score", "vec_id", _share(df, moved)).select("vec_id")


def _share(df, cond):
    """The fraction of the rows that meets a condition, so that a top slice has as many."""
    n, k = df.agg(F.count("*"), F.count_if(cond)).first()
    return (k - 0.5) / n


@plan("anomaly_scores_of_events", "event_id:l split:s", f"""
  select event_id, split from {SQL_GAPPY_SPLIT} e where split <> 'train' and event_id % 97 = 0""")
def anomaly_scores_of_events(spark, d):
    """Forest on prepared events, its configuration chosen on validation rows; among validation and test rows the planted amounts score highest."""
    planted = F.col("event_id") % 97 == 0
    df = materialized(_gappy_split(spark, d).withColumn("value", F.when(planted, F.col("event_id") * 1000.0 + 1e6).otherwise(F.col("value"))).withColumn("label", planted.cast("int")))
    ready = prep.anomaly_prep(df, _part(df, "train"), ["value"], [], keep=["event_id", "label", "split"])
    ready = materialized(ready.select("event_id", "label", "split", F.array("value").alias("features")))
    grown, _ = forest.choose_forest(_part(ready, "train"), _part(ready, "val"), "event_id", [{"n_trees": 30}, {"n_trees": 60, "sample_rows": 512}])
    rest = ready.where("split <> 'train'")
    scored = materialized(forest.anomaly_score(rest, grown, ["event_id", "label", "split"]))
    return ranking.top_fraction(scored, "anomaly_score", "event_id", _share(rest, F.col("label") == 1)).select("event_id", "split")


@plan("score_batch", "n_test:l n_reported:l n_agree:l shares_add_up:b", f"""
  select count(*) as n_test, count(*) as n_reported, count(*) as n_agree, true as shares_add_up from {SQL_LABELLED} e where split = 'test'""")
def score_batch(spark, d):
    """Features, model with categories, policy from validation rows, decisions on test rows, report.

    The report counts every test row, and its counts are those of the thresholds applied anew to the scores.
    """
    df = model_table(spark, d)
    made = models.train_boosted_trees(_part(df, "train"), _part(df, "val"), "event_id", NUMERIC, CATEGORIES, rounds=10, leaves=15, rate=0.1)
    scored = materialized(made.score(df.where("split <> 'train'"), ["event_id", "label", "split"]))
    chosen = policy.as_policy(policy.derive_policies(_part(scored, "val"), [("balanced", 0.2, 0.6)], step=0.01, id_col="event_id").first())
    test = _part(scored, "test")
    report = policy.policy_report(test, approve=chosen.approve_threshold, block=chosen.block_threshold)
    low, high = F.col("score") < chosen.approve_threshold, F.col("score") >= chosen.block_threshold
    anew = test.agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("APPROVE"), F.count_if(~low & ~high).alias("REVIEW"), F.count_if(~low & high).alias("BLOCK")).first()
    want = F.coalesce(*[F.when(F.col("decision") == k, F.lit(anew[k])) for k in ("APPROVE", "REVIEW", "BLOCK")])
    return report.agg(F.lit(anew["n"]).alias("n_test"), F.sum("n").alias("n_reported"), F.sum(F.when(F.col("n") == want, F.col("n")).otherwise(0)).alias("n_agree"),
                      (F.abs(F.sum("share") - 1) < 1e-9).alias("shares_add_up"))
