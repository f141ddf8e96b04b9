import math

import pytest
from pyspark.sql import functions as F

from sparkrisk.functions.roles import Roles
from sparkrisk.operators.history import feature_names, history_features

R = Roles()
SCHEMA = "id long, time long, entity string, amount double"


def features(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    kw.setdefault("hot_rows", None)
    return {r["id"]: r for r in history_features(df, R, **kw).collect()}


@pytest.fixture(params=[None, 0], ids=["windows", "chunks"])
def hot(request):
    """The plain plan, and the chunked plan for every entity."""
    return request.param


def test_first_and_second_row(spark, hot):
    got = features(spark, [(1, 100, "A", 50.0), (2, 200, "A", 70.0)], hot_rows=hot)
    assert got[1]["bhv_prev_txn_count"] == 0 and got[1]["bhv_hist_mean_amt"] is None
    b = got[2]
    assert (b["bhv_prev_txn_count"], b["bhv_hist_mean_amt"], b["bhv_hist_min_amt"], b["bhv_hist_max_amt"]) == (1, 50, 50, 50)
    assert b["bhv_hist_std_amt"] is None and b["bhv_time_since_prev_txn"] == 100
    assert b["bhv_prev_txn_count_log1p"] == pytest.approx(math.log(2))


def test_equal_time_is_ordered_by_id(spark, hot):
    got = features(spark, [(20, 100, "A", 50.0), (10, 100, "A", 30.0)], hot_rows=hot)
    assert got[10]["bhv_prev_txn_count"] == 0
    assert got[20]["bhv_prev_txn_count"] == 1 and got[20]["bhv_hist_mean_amt"] == 30
    assert got[20]["bhv_prior_count_1h"] == 1 and got[10]["bhv_prior_count_1h"] == 0


def test_future_rows_change_nothing(spark, hot):
    rows = [(1, 100, "A", 50.0), (2, 200, "A", 70.0)]
    before = features(spark, rows, hot_rows=hot)
    after = features(spark, rows + [(3, 10_000_000, "A", 30.0)], hot_rows=hot)
    assert before[1] == after[1] and before[2] == after[2]


def test_zero_deviation_and_zero_mean(spark, hot):
    got = features(spark, [(1, 1, "A", 10.0), (2, 2, "A", 10.0), (3, 3, "A", 10.0),
                           (4, 1, "B", 0.0), (5, 2, "B", 50.0)], hot_rows=hot)
    assert got[3]["bhv_hist_std_amt"] == 0 and got[3]["bhv_amt_zscore"] is None
    assert got[5]["bhv_amt_to_hist_mean_ratio"] is None


def test_missing_amount_counts_but_has_no_value(spark, hot):
    got = features(spark, [(1, 100, "A", None), (2, 200, "A", 20.0), (3, 300, "A", None), (4, 400, "A", 5.0)], hot_rows=hot)
    assert got[2]["bhv_prev_txn_count"] == 1 and got[2]["bhv_hist_mean_amt"] is None
    assert got[3]["bhv_hist_mean_amt"] == 20 and got[4]["bhv_hist_min_amt"] == 20


def test_velocity_is_inclusive(spark, hot):
    got = features(spark, [(1, 0, "A", 1.0), (2, 1800, "A", 1.0), (3, 5000, "A", 1.0), (4, 5100, "A", 1.0), (5, 8700, "A", 1.0),
                           (6, 0, "B", 1.0), (7, 100_000, "B", 1.0)], hot_rows=hot)
    assert got[4]["bhv_prior_count_1h"] == 2 and got[4]["bhv_prior_count_24h"] == 3
    assert got[5]["bhv_prior_count_1h"] == 1  # 5100 is exactly one hour before 8700
    assert got[7]["bhv_prior_count_24h"] == 0 and got[7]["bhv_prev_txn_count"] == 1


def test_fractional_seconds(spark):
    df = spark.createDataFrame([(1, 0.0, "A", 1.0), (2, 3600.0, "A", 1.0), (3, 3600.5, "A", 1.0)], "id long, time double, entity string, amount double")
    for hot in (None, 0):
        got = {r["id"]: r for r in history_features(df, R, hot_rows=hot).collect()}
        assert got[2]["bhv_prior_count_1h"] == 1 and got[3]["bhv_prior_count_1h"] == 1


def test_null_entities_have_no_history(spark, hot):
    got = features(spark, [(1, 1, None, 1.0), (2, 2, None, 1.0)], hot_rows=hot)
    assert got[1]["bhv_prev_txn_count"] == got[2]["bhv_prev_txn_count"] == 0


def test_variance_survives_large_offset(spark, hot):
    import numpy as np
    a = 1_000_000 + np.random.default_rng(7).normal(0, 0.001, 3000)
    df = spark.createDataFrame([(i, i, "A", float(x)) for i, x in enumerate(a)], SCHEMA)
    last = history_features(df, R, hot_rows=hot).where(F.col("id") == 2999).first()
    assert last["bhv_hist_std_amt"] == pytest.approx(np.std(a[:-1], ddof=1), abs=1e-6)


def test_hot_entity_plan_equals_plain_plan(spark):
    rows = [(i, (i * 37) % 5000 * 60, "hot" if i % 3 else f"e{i % 50}", float((i * 7919) % 1000) if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {r["id"]: r for r in history_features(df, R, hot_rows=None).collect()}
    for r in history_features(df, R, hot_rows=500).collect():
        for c in feature_names():
            x, y = r[c], plain[r["id"]][c]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-7)), (r["id"], c)


def test_partition_count_and_row_order_do_not_matter(spark):
    df = spark.createDataFrame([(i, i // 2, f"e{i % 7}", float(i % 13)) for i in range(300)], SCHEMA)
    def run():
        return sorted(map(tuple, history_features(df.orderBy(F.rand(3)), R).collect()))
    first = run()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_label_is_refused(spark):
    df = spark.createDataFrame([(1, 1, "A", 1.0, 0)], SCHEMA + ", label int")
    with pytest.raises(ValueError):
        history_features(df, R, forbid=["label"])


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "A", 1.0)], SCHEMA)
    plan = history_features(df, R, hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
