"""All plans, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.history import history_features
from ..operators.policy import policy_report
from . import drifting, evaluation, learning, profiling, streams  # noqa: F401  (importing registers the plans)
from .bindings import EVENTS, labelled_events
from .registry import ORACLES, PLANS, plan  # noqa: F401


@plan("flagship", evaluation.REPORT_COLUMNS, f"""
  with h as (select h.*, label from {profiling.SQL_HISTORY} h join {profiling.SQL_EVENTS} e on e.event_id = h.event_id),
  x as (select label, case when score < 0.3 then 'APPROVE' when score < 0.6 then 'REVIEW' else 'BLOCK' end as decision
    from (select label, 1.0 / (1.0 + exp(-coalesce(bhv_amt_zscore, 0) / 2.0)) as score from h) s)
  select v.decision, count(x.label) as n, count(x.label) / (select count(*) from events)::double as share, coalesce(sum(label), 0) as positives,
    count(x.label) - coalesce(sum(label), 0) as negatives, avg(label) as positive_rate
  from (values ('APPROVE'), ('REVIEW'), ('BLOCK')) v(decision) left join x on x.decision = v.decision group by v.decision""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History features of all events, a fixed score on the amount's deviation, decisions, report."""
    features = history_features(labelled_events(spark, sf_dir), EVENTS, keep=["label"])
    score = 1.0 / (1.0 + F.exp(-F.coalesce(F.col("bhv_amt_zscore"), F.lit(0.0)) / 2.0))
    return policy_report(features.withColumn("score", score), approve=0.3, block=0.6)
