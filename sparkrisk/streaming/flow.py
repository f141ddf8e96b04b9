"""Streaming queries built from the batch expressions plus one stateful operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.expressions import time_axis
from ..functions.roles import Roles, require_columns
from ..operators.history import WIDTHS, feature_names
from ..operators.rows import row_errors
from ..operators.state import entity_state, recent_times
from .processor import GROUPS, INLINE_TIMES, GroupProcessor, HistoryProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY_BATCHES_CONF = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """The stateful operator needs this provider; it also keeps large state out of the heap."""
    spark.conf.set(PROVIDER_CONF, ROCKSDB)


def warm_start_table(history: DataFrame, roles: Roles, as_of=None, width_seconds: int = 86400) -> DataFrame:
    """Initial state of the stream from a history table (G2): state rows and recent-time rows.

    ``as_of`` (axis units) defaults to the last time of the history.
    """
    if as_of is None:
        t, _ = time_axis(history, roles.time)
        as_of = history.agg(F.max(t)).first()[0]  # one scalar
    state = entity_state(history, roles).withColumn("kind", F.lit("state"))
    times = recent_times(history, roles, as_of, width_seconds).select(
        "entity", F.col("n").cast("long").alias("n"), F.col("time").alias("last_time"), F.lit("time").alias("kind"))
    return state.unionByName(times, allowMissingColumns=True)


def _times(packed: pa.Array) -> pa.Array:
    """Times as the processor packs them: whole numbers of 64 bits."""
    held = [np.frombuffer(b or b"", dtype=np.int64) for b in packed.to_pylist()]
    sizes = np.cumsum([0, *map(len, held)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.empty(0, np.int64), *held])))


def state_snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The running state of a stopped ``stream_features`` query, read from its checkpoint.

    The result is as ``warm_start_table`` gives it: another query begins with it where this one ended. Values are the
    moments and the newest times of each entity, the map the older times in their buckets.
    """
    metadata = spark.read.format("state-metadata").load(checkpoint)
    operator = metadata.where(F.col("operatorName").contains("transformWithState")).agg(F.min("operatorId")).first()[0]
    if operator is None:
        raise ValueError("state_snapshot: the checkpoint holds no state of stream_features")

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(checkpoint)
    moments = state("moments").select("list_element.*").where("last is not null")
    kept = moments.select("entity", "n", F.col("m").alias("n_amt"), F.when(F.col("m") > 0, F.col("mean")).alias("mean_amt"), "m2",
                          F.col("low").alias("min_amt"), F.col("high").alias("max_amt"), F.col("last").alias("last_time"), F.lit("state").alias("kind"))
    old = state("old_times").select(F.col("user_map_key").getField("entity").alias("entity"), F.col("user_map_value").getField("times").alias("times"))
    times = moments.select("entity", "times").unionByName(old).select("entity", F.explode(F.arrow_udf(_times, T.ArrayType(T.LongType()))("times")).alias("last_time"))
    times = times.groupBy("entity", "last_time").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("time"))
    return kept.unionByName(times, allowMissingColumns=True)


def stream_features(events: DataFrame, roles: Roles, keep: Sequence[str] = (), widths: dict[str, int] = WIDTHS,
                    initial: DataFrame | None = None, late: str = "accept", ttl_ms: int | None = None,
                    inline_times: int = INLINE_TIMES, groups: int = GROUPS) -> DataFrame:
    """History features of each event from keyed state; the event never sees itself.

    State is kept for ``groups`` groups of entities, each of them one key; a checkpoint needs the number it began with.

    Events without an entity or a time belong to no history: they pass beside the state, with no
    earlier rows, as in the batch operator, so they are no key that all of them would share.
    """
    require_columns(events, [roles.id, roles.time, roles.entity, roles.amount, *keep], "stream_features")
    if late not in ("accept", "route"):
        raise ValueError("late must be 'accept' or 'route'")
    use_rocksdb(events.sparkSession)
    time, units = time_axis(events, roles.time)
    spans = {w: s * units for w, s in widths.items()}
    extra = [c for c in keep if c != roles.id]
    placed = F.col(roles.entity).isNotNull() & F.col(roles.time).isNotNull()
    group = F.pmod(F.xxhash64("entity"), F.lit(groups)).cast("int")
    narrow = events.where(placed).select(F.col(roles.entity).alias("entity"), F.col(roles.id).alias("row_id"), time.cast("long").alias("row_time"),
                           F.col(roles.amount).cast("double").alias("row_amount"),
                           *[F.col(c).alias(f"k{i}") for i, c in enumerate(extra)])
    fields = [T.StructField(roles.id, events.schema[roles.id].dataType)]
    fields += [T.StructField(c, events.schema[c].dataType) for c in extra]
    names = feature_names(widths)
    whole = [n for n in names if n == "bhv_prev_txn_count" or n.startswith("bhv_prior_count_")]
    fields += [T.StructField(n, T.LongType() if n in whole else T.DoubleType()) for n in names] + [T.StructField("is_late", T.BooleanType())]
    entity_type = events.schema[roles.entity].dataType.simpleString()
    processor = GroupProcessor(HistoryProcessor(roles.id, extra, names, spans, units, late, inline_times), entity_type, ttl_ms)
    known = narrow.withColumn("group", group).groupBy("group").transformWithStateInPandas(
        processor, T.StructType(fields), "Append", "ProcessingTime" if ttl_ms else "None",
        initialState=initial.withColumn("entity", F.col("entity").cast(entity_type)).withColumn("group", group).groupBy("group") if initial is not None else None)
    zero = [*whole, "bhv_prev_txn_count_log1p"]
    alone = events.where(~placed).select(roles.id, *extra, *[
        (F.lit(0) if f.name in zero else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields[1 + len(extra):-1]],
        F.lit(False).alias("is_late"))
    return known.unionByName(alone)


def dedup_stream(events: DataFrame, id_col: str, delay: str = "2 days") -> DataFrame:
    """Drop repeated ids; an id is remembered for ``delay`` after its arrival, also after a restart.

    The clock is the arrival, not the event's own time, so no event is ever too late to be taken.
    """
    arrived = events.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", delay)
    return arrived.dropDuplicatesWithinWatermark([id_col]).drop("__arrived")


def route_invalid(events: DataFrame, roles: Roles) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows; invalid ones carry error_reason and never reach the state."""
    checked = row_errors(events, roles)
    return checked.where(F.col("error_reason").isNull()).drop("error_reason"), checked.where(F.col("error_reason").isNotNull())


def score_stream(events: DataFrame, roles: Roles, score: Callable[[DataFrame], DataFrame], keep: Sequence[str] = (),
                 initial: DataFrame | None = None, dedup: bool = True, delay: str = "2 days",
                 late: str = "accept") -> DataFrame:
    """Validate, drop repeats, compute features from state, score and decide.

    ``score`` is a batch function (model.transform, decide) that adds ``score`` and ``decision``.
    Rejected rows come out of the same query with ``error_reason``, for split_sink; with
    ``late="route"`` an event older than its entity's last one is such a row (``late``), without a score.
    """
    valid, invalid = route_invalid(events, roles)
    if dedup:
        valid = dedup_stream(valid, roles.id, delay)
    scored = score(stream_features(valid, roles, keep=keep, initial=initial, late=late))
    rejected = invalid.select(roles.id, *[c for c in keep if c != roles.id], "error_reason",
                              F.to_json(F.struct(*events.columns)).alias("raw_event"))
    in_time = ~F.col("is_late")
    out = scored.withColumns({"error_reason": F.when(F.col("is_late"), "late"), "raw_event": F.lit(None).cast("string"),
                              "score": F.when(in_time, F.col("score")), "decision": F.when(in_time, F.col("decision"))})
    return out.unionByName(rejected, allowMissingColumns=True)


def monitor_counts(decisions: DataFrame, time_col: str, decision: str = "decision", width: str = "1 hour",
                   score: str | None = None, error: str | None = None, buckets: int = 10) -> DataFrame:
    """Counts per time window of decisions, score buckets and failures by reason: (window_start, metric, value, n)."""
    cells = [F.struct(F.lit("decision").alias("metric"), F.col(decision).cast("string").alias("value"))]
    if score:
        low = F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1))
        cells.append(F.struct(F.lit("score_bucket").alias("metric"), low.cast("string").alias("value")))
    if error:
        cells.append(F.struct(F.lit("failure").alias("metric"), F.col(error).alias("value")))
    long = decisions.select(F.window(F.col(time_col).cast("timestamp"), width).alias("w"), F.explode(F.array(*cells)).alias("c"))
    return long.where("c.value is not null").groupBy("w", "c.metric", "c.value").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "metric", "value", "n")


def monitor_sink(path: str, **columns) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each micro-batch's counts.

    The query keeps no state at all, however long it runs and however many windows there are, and a late event is counted by
    the batch that brings it. A batch owns its folder, so one that is repeated counts once. ``columns`` are those of
    ``monitor_counts``.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        monitor_counts(batch, **columns).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def monitor_totals(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all batches so far: (window_start, metric, value, n)."""
    return spark.read.parquet(path).groupBy("window_start", "metric", "value").agg(F.sum("n").alias("n"))


def stop_after_batch(query, seconds: float = 60.0) -> bool:
    """Stop a running query between two micro-batches (G9); False if one was still running after ``seconds``."""
    import time
    end = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.05)
    idle = not (query.isActive and query.status["isTriggerActive"])
    query.stop()
    return idle


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, finish the batch in flight and stop (G9); returns the written table.

    Each epoch owns a folder and overwrites it when replayed, so a restart adds nothing twice.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    conf = df.sparkSession.conf
    before = conf.get(EMPTY_BATCHES_CONF)
    # state with a time to live would ask for empty batches for ever, so a bounded run takes none
    conf.set(EMPTY_BATCHES_CONF, "false")
    try:
        query = (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
                 .trigger(availableNow=True).start())
    finally:
        conf.set(EMPTY_BATCHES_CONF, before)
    query.awaitTermination()
    return df.sparkSession.read.schema(T.StructType(df.schema.fields + [T.StructField("epoch", T.LongType())])).parquet(path)
