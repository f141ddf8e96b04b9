import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkrisk.functions.roles import Roles
from sparkrisk.functions.session import scratch_path
from sparkrisk.operators.compare import feature_parity
from sparkrisk.operators.history import feature_names, history_features
from sparkrisk.sources import streams
from sparkrisk.streaming import flow, processor

R = Roles()
SCHEMA = "id long, time long, entity long, amount double"


def arrivals(spark, parts, schema=SCHEMA):
    path = scratch_path(spark, "arrivals")
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(path)
    return streams.file_stream(spark, path, spark.createDataFrame([], schema).schema, max_files_per_trigger=1)


def run(df, mode="append"):
    spark = df.sparkSession
    return flow.run_available(df, scratch_path(spark, "out"), scratch_path(spark, "state"), mode)


def make(n=300, seed=7, entities=7, top=300_000):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(0, top, n))
    return [(i, int(t[i]), int(rng.integers(1, entities + 1)), float(rng.uniform(1, 200))) for i in range(n)]


def parity(spark, online, rows):
    off = history_features(spark.createDataFrame(rows, SCHEMA), R, hot_rows=None)
    return feature_parity(online, off, "id", feature_names(), 1e-6).first()


def test_stream_equals_windows(spark):
    rows = make()
    got = parity(spark, run(flow.stream_features(arrivals(spark, [rows[:100], rows[100:101], rows[101:]]), R)), rows)
    assert got["n_rows_matching"] == 300 and got["n_mismatches"] == 0


def test_warm_start_equals_replay(spark):
    rows = make(60, 0, 3, 200_000)
    history = spark.createDataFrame(rows[:40], SCHEMA)
    live = arrivals(spark, [rows[40:50], rows[50:]])
    got = parity(spark, run(flow.stream_features(live, R, initial=flow.warm_start_table(history, R))), rows)
    assert got["n_rows_compared"] == 20 and got["n_mismatches"] == 0


def test_late_events(spark):
    first, late = [(1, 100, 1, 5.0), (2, 200, 1, 7.0)], [(3, 150, 1, 9.0)]
    out = {r["id"]: r for r in run(flow.stream_features(arrivals(spark, [first, late]), R)).collect()}
    assert out[3]["bhv_time_since_prev_txn"] == -50 and out[3]["bhv_prev_txn_count"] == 2 and not out[3]["is_late"]
    out = {r["id"]: r for r in run(flow.stream_features(arrivals(spark, [first, late]), R, late="route")).collect()}
    assert out[3]["is_late"] and out[3]["bhv_prev_txn_count"] is None


def test_duplicate_is_processed_once(spark):
    schema = "id long, time timestamp, entity long, amount double"
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), 1, 1.0) for i in range(5)]
    live = flow.dedup_stream(arrivals(spark, [rows, rows[:3]], schema), "id", "1 day")
    out = run(flow.stream_features(live, R)).collect()
    assert sorted(r["bhv_prev_txn_count"] for r in out) == [0, 1, 2, 3, 4]


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map(dict):
    def getValue(self, k):
        return self.get(k)

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


@pytest.mark.parametrize("inline", [8, 10_000])
def test_busy_entity_spills_and_stays_exact(inline):
    p = processor.HistoryProcessor("id", [], feature_names(), {"1h": 3600, "24h": 86400}, 1, inline_times=inline)
    p.state, p.spill = Value(), Map()
    rng = np.random.default_rng(1)
    t = np.sort(rng.integers(0, 400_000, 2000))
    got = []
    for part in np.array_split(np.arange(2000), 60):
        frame = pd.DataFrame({"row_id": part, "row_time": t[part], "row_amount": 1.0})
        got.append(pd.concat(p.handleInputRows((1,), iter([frame.sample(frac=1, random_state=0)]), None)))
    out = pd.concat(got).sort_values("id")
    for i in range(0, 2000, 37):
        assert out["bhv_prior_count_24h"].iloc[i] == int((t[:i] >= t[i] - 86400).sum())
        assert out["bhv_prior_count_1h"].iloc[i] == int((t[:i] >= t[i] - 3600).sum())
    if inline == 8:
        assert p.spill and sum(len(v[0]) // 8 for v in p.spill.values()) < 2000


def test_invalid_rows_reach_the_dead_letters_not_the_state(spark):
    rows = [(1, 10, 1, 5.0), (2, 20, 1, -1.0), (3, 30, 1, None), (4, 40, 1, 7.0)]
    def score(df):
        return df.withColumns({"score": F.lit(0.5), "decision": F.lit("REVIEW")})
    live = flow.score_stream(arrivals(spark, [rows]), R, score, dedup=False)
    out = {r["id"]: r for r in run(live).collect()}
    assert "negative" in out[2]["error_reason"] and "field_null" in out[3]["error_reason"]
    assert out[4]["bhv_prev_txn_count"] == 1 and out[4]["decision"] == "REVIEW" and out[4]["error_reason"] is None


def loop_moments(a):
    n, mean, m2, out = 0, 0.0, 0.0, []
    for x in a:
        if x == x:
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
        out.append((n, mean, m2))
    return np.array(out).T


@pytest.mark.parametrize("size", [1, 2, 3, 64, 1000, 4097])
def test_prefix_moments_equal_the_loop(size):
    rng = np.random.default_rng(size)
    a = 1e6 + rng.normal(0, 1, size)
    a[rng.random(size) < 0.2] = np.nan
    n, mean, m2 = processor.prefix_moments(a)
    want = loop_moments(a)
    assert (n == want[0]).all() and np.allclose(mean, want[1], rtol=1e-12) and np.allclose(m2, want[2], rtol=1e-6, atol=1e-6)


def empty_state():
    none = np.empty(0, dtype=np.int64)
    return dict(n=0, m=0, mean=0.0, m2=0.0, low=None, high=None, last=None, times=none, ids=none, counts=none)


def test_a_hot_key_in_chunks_is_what_it_is_at_once():
    """A million events of one key: the same features whether they are made at once or chunk by chunk."""
    rng = np.random.default_rng(1)
    n = 1_000_000
    frame = pd.DataFrame({"row_id": np.arange(n), "row_time": np.sort(rng.integers(0, 10 ** 8, n)), "row_amount": 1e6 + rng.normal(0, 1e-3, n)})
    frame.loc[rng.random(n) < 0.1, "row_amount"] = np.nan
    p = processor.HistoryProcessor("row_id", [], [], {"h": 3600, "d": 86400}, 1)
    whole, state = p._advance(empty_state(), frame), empty_state()
    parts = [p._advance(state, frame.iloc[k:k + processor.CHUNK]) for k in range(0, n, processor.CHUNK)]
    for name in whole:
        assert np.allclose(np.concatenate([x[name] for x in parts]), whole[name], rtol=1e-9, atol=1e-9, equal_nan=True), name
    assert abs(whole["std"][-1] - 1e-3) < 1e-5


def test_snapshot_of_a_stopped_stream(spark):
    """State read from the checkpoint, older times in their buckets included, goes on where the query ended."""
    rows = make(400, entities=2, top=90_000)
    path, state = scratch_path(spark, "arrivals"), scratch_path(spark, "state")
    spark.createDataFrame(rows[:300], SCHEMA).write.parquet(path)
    schema = spark.createDataFrame([], SCHEMA).schema
    flow.run_available(flow.stream_features(streams.file_stream(spark, path, schema), R, inline_times=8), scratch_path(spark, "out"), state)
    buckets = spark.read.format("statestore").option("stateVarName", "old_times").load(state)
    assert buckets.count() > 0
    initial = flow.state_snapshot(spark, state)
    assert initial.where("kind = 'state'").agg(F.sum("n")).first()[0] == 300
    rest = run(flow.stream_features(arrivals(spark, [rows[300:]]), R, initial=initial, inline_times=8))
    off = history_features(spark.createDataFrame(rows, SCHEMA), R, hot_rows=None).where("id >= 300")
    assert feature_parity(rest, off, "id", feature_names(), 1e-6).first()["n_mismatches"] == 0


def test_monitor_counts_late_rows_and_repeated_batches(spark):
    rows = [(i, (i * 37) % 10_000, 1, 0.1 * (i % 10)) for i in range(60)]
    sink = flow.monitor_sink(path := scratch_path(spark, "monitor"), time_col="at", score="amount")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.timestamp_seconds("time"), "decision": F.lit("APPROVE")})
    sink(df.where("id < 30"), 0)
    sink(df.where("id >= 30"), 1)
    sink(df.where("id >= 30"), 1)  # a batch that is replayed
    totals = flow.monitor_totals(spark, path)
    assert totals.where("metric = 'decision'").agg(F.sum("n")).first()[0] == 60
    assert totals.where("metric = 'score_bucket'").count() == flow.monitor_counts(df, "at", score="amount").where("metric = 'score_bucket'").count()


def test_stop_between_batches(spark):
    live = arrivals(spark, [make(40, seed=k) for k in range(3)])
    query = live.writeStream.foreachBatch(lambda b, e: b.count()).option("checkpointLocation", scratch_path(spark, "state")).trigger(processingTime="50 milliseconds").start()
    while not query.recentProgress:
        pass
    assert flow.stop_after_batch(query) and not query.isActive


class Listed:
    """A list state that counts how often it is read and written."""

    def __init__(self):
        self.rows, self.reads, self.writes = [], 0, 0

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def put(self, rows):
        self.writes += 1
        self.rows = list(rows)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def group_processor(ttl_ms=None, late="accept"):
    own = processor.HistoryProcessor("id", [], feature_names(), {"1h": 3600, "24h": 86400}, 1, late, inline_times=8)
    p = processor.GroupProcessor(own, "bigint", ttl_ms)
    p.state, p.spill = Listed(), Map()
    return p


def test_entities_of_a_group_share_calls_and_state():
    """A thousand entities of one group: state is read and written once a micro-batch, and each has its own history."""
    p, rng = group_processor(), np.random.default_rng(2)
    frame = pd.DataFrame({"entity": rng.integers(0, 1000, 8000), "row_id": np.arange(8000), "row_time": rng.integers(0, 10 ** 6, 8000), "row_amount": 2.0})
    frame = frame.sort_values(["row_time", "row_id"], ignore_index=True)
    parts = [frame[:5000], frame[5000:]]
    out = pd.concat(f for x in parts for f in p.handleInputRows((0,), iter([x.sample(frac=1, random_state=1)]), Clock(-1))).set_index("id")
    assert (p.state.reads, p.state.writes, len(p.state.rows)) == (2, 2, frame["entity"].nunique())
    got = out.loc[frame["row_id"]]
    assert (got["bhv_prev_txn_count"].to_numpy() == frame.groupby("entity").cumcount().to_numpy()).all()
    for i in range(0, 8000, 171):
        earlier = frame[:i][frame["entity"][:i] == frame["entity"][i]]["row_time"]
        assert got["bhv_prior_count_24h"].iloc[i] == (earlier >= frame["row_time"][i] - 86400).sum()


def test_entities_of_a_group_expire_one_by_one():
    p = group_processor(ttl_ms=1000)
    def send(now, *entities):
        rows = pd.DataFrame({"entity": entities, "row_id": range(len(entities)), "row_time": now, "row_amount": 1.0})
        return dict(zip(entities, pd.concat(p.handleInputRows((0,), iter([rows]), Clock(now))).sort_values("id")["bhv_prev_txn_count"]))
    assert send(0, 1, 2) == {1: 0, 2: 0}
    assert send(600, 2) == {2: 1}
    assert send(1200, 1, 2) == {1: 0, 2: 2}
