"""How the test tables play the roles of a transaction table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.roles import Roles
from ..operators.split import temporal_split

EVENTS = Roles(id="event_id", time="ts", entity="user_id", amount="value", label="label")
ORDERS = Roles(id="o_orderkey", time="o_orderdate", entity="o_custkey", amount="o_totalprice", label="label")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a label (errors), score (many ties) and score_b (few ties)."""
    return table(spark, sf_dir, "events").withColumns({
        "label": (F.col("event_type") == "error").cast("int"),
        "score": F.least(F.col("value") / 500.0, F.lit(1.0)),
        "score_b": ((F.col("event_id") * 7919) % 10007) / 10007.0})


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns({
        "label": (F.col("o_orderstatus") == "F").cast("int"),
        "score": F.least(F.col("o_totalprice") / 600000.0, F.lit(1.0))})


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a toxicity label; the score is their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", F.col("toxic").alias("label"),
                                              F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"))


def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_split(labelled_events(spark, sf_dir), EVENTS)


def with_gaps(df: DataFrame) -> DataFrame:
    """Every tenth amount and every seventh type missing (the tables have no NULLs)."""
    return df.withColumns({"value": F.when(F.col("event_id") % 10 != 0, F.col("value")),
                           "event_type": F.when(F.col("event_id") % 7 != 0, F.col("event_type"))})


# ---- the same in SQL ------------------------------------------------------------------

SQL_EVENTS = """(select event_id, ts, user_id, event_type, value, props,
  cast(event_type = 'error' as int) as label, least(value / 500.0::double, 1.0::double) as score,
  ((event_id * 7919) % 10007) / 10007.0::double as score_b, epoch_us(ts) as t from events)"""

SQL_ORDERS = """(select *, cast(o_orderstatus = 'F' as int) as label,
  least(o_totalprice / 600000.0::double, 1.0::double) as score, epoch_us(o_orderdate) as t from orders)"""

SQL_DOCUMENTS = """(select d.doc_id, d.lang, d.source, l.toxic as label,
  least(d.n_chars / 20000.0::double, 1.0::double) as score from documents d join labels l on d.doc_id = l.doc_id)"""

SQL_GAPS = """(select event_id, ts, user_id, case when event_id % 7 <> 0 then event_type end as event_type,
  case when event_id % 10 <> 0 then value end as value, cast(event_type = 'error' as int) as label,
  epoch_us(ts) as t from events)"""


def split_sql(src: str, id_col: str = "event_id") -> str:
    return f"""(select * exclude (rn, nn), case when rn <= cast(floor(nn * 0.7::double) as bigint) then 'train'
  when rn <= cast(floor(nn * (0.7::double + 0.15::double)) as bigint) then 'val' else 'test' end as split
  from (select *, row_number() over (order by t, {id_col}) as rn, count(*) over () as nn from {src} s0) s1)"""


SQL_SPLIT = split_sql(SQL_EVENTS)


def history_sql(src: str, id_col: str, entity: str, amount: str, keep: str = "") -> str:
    """History features by window functions and a self join for the velocity counts."""
    keep = f"{keep}, " if keep else ""
    return f"""(with x as (select * from {src} h0),
  v as (select a.{id_col} as vid, count(b.{id_col}) filter (b.t >= a.t - 3600000000) as c1, count(b.{id_col}) as c24
        from x a left join x b on a.{entity} = b.{entity} and (b.t < a.t or (b.t = a.t and b.{id_col} < a.{id_col}))
          and b.t >= a.t - 86400000000 group by a.{id_col}),
  m as (select *, row_number() over w - 1 as n0, avg({amount}) over p as mean0, stddev_samp({amount}) over p as std0,
          min({amount}) over p as min0, max({amount}) over p as max0, lag(t) over w as last0 from x
        window w as (partition by {entity} order by t, {id_col}),
               p as (partition by {entity} order by t, {id_col} rows between unbounded preceding and 1 preceding))
  select {id_col}, {keep}n0 as bhv_prev_txn_count, ln(1 + n0) as bhv_prev_txn_count_log1p, mean0 as bhv_hist_mean_amt,
    std0 as bhv_hist_std_amt, min0 as bhv_hist_min_amt, max0 as bhv_hist_max_amt,
    (t - last0) / 1000000.0::double as bhv_time_since_prev_txn,
    {amount} / nullif(mean0, 0) as bhv_amt_to_hist_mean_ratio, {amount} - mean0 as bhv_amt_diff_from_hist_mean,
    case when min0 <> max0 then ({amount} - mean0) / nullif(std0, 0) end as bhv_amt_zscore,
    c1 as bhv_prior_count_1h, c24 as bhv_prior_count_24h
  from m join v on m.{id_col} = v.vid)"""


HISTORY_COLUMNS = ("bhv_prev_txn_count:l bhv_prev_txn_count_log1p:d bhv_hist_mean_amt:d bhv_hist_std_amt:d "
                   "bhv_hist_min_amt:d bhv_hist_max_amt:d bhv_time_since_prev_txn:d bhv_amt_to_hist_mean_ratio:d "
                   "bhv_amt_diff_from_hist_mean:d bhv_amt_zscore:d bhv_prior_count_1h:l bhv_prior_count_24h:l")

SQL_HISTORY = history_sql(SQL_EVENTS, "event_id", "user_id", "value")


def curve_sql(src: str, by: str = "", score: str = "score") -> str:
    """Distinct scores with running totals, descending; ``by`` is a comma-separated list."""
    p = f"partition by {by}" if by else ""
    b = f"{by}, " if by else ""
    return f"""(select {b}threshold, n, p, sum(n) over (w) as cn, sum(p) over (w) as cp,
  sum(n) over ({p}) as tn, sum(p) over ({p}) as tp from (select {b}{score} as threshold, count(*) as n, sum(label) as p
  from {src} c0 group by {b}{score}) c1 window w as ({p} order by threshold desc))"""


def metrics_sql(src: str, by: str = "", score: str = "score") -> str:
    b = f"{by}, " if by else ""
    g = f"group by {by}" if by else ""
    return f"""(select {b}max(tn) as n_rows, max(tp) as n_positive,
  case when max(tp) between 1 and max(tn) - 1 then sum(p * cp / cn) / max(tp) end as average_precision,
  case when max(tp) between 1 and max(tn) - 1 then
    sum((n - p) * (cp - p / 2.0::double)) / (max(tp)::double * (max(tn) - max(tp))) end as roc_auc
  from {curve_sql(src, by, score)} k {g})"""


def ranked_sql(src: str, by: str = "", score: str = "score", id_col: str = "event_id") -> str:
    p = f"partition by {by}" if by else ""
    return f"""(select *, row_number() over w as rank, sum(label) over w as cum_y, count(*) over ({p}) as n_rows,
  sum(label) over ({p}) as n_positive from {src} r0 window w as ({p} order by {score} desc, {id_col} desc
  rows between unbounded preceding and current row))"""


def budgets_sql(src: str, budgets: str, by: str = "", score: str = "score", id_col: str = "event_id") -> str:
    """``budgets`` is a query with one column b."""
    g = f"{by}, " if by else ""
    return f"""(select {g}b as budget, n_rows, rank as n_reviewed, cum_y as captured, n_positive,
  cum_y / nullif(n_positive, 0)::double as recall, cum_y / rank::double as precision, {score} as cutoff_score
  from {ranked_sql(src, by, score, id_col)} q join ({budgets}) bb on rank = greatest(1, cast(ceil(n_rows * b) as bigint)))"""


def values_sql(items) -> str:
    return "select unnest([" + ", ".join(f"{float(i)!r}::double" for i in items) + "]) as b"


def decide_sql(score: str, approve: float, block: float) -> str:
    return f"case when {score} < {approve} then 'APPROVE' when {score} < {block} then 'REVIEW' else 'BLOCK' end"
