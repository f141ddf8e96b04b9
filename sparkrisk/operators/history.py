"""Leakage-safe history features per entity (W1-W6) and their diagnostics.

Every value describes strictly earlier rows in (time, id) order. NULL amounts are rows of history
(they count) without an amount (they do not enter mean, deviation, minimum or maximum). A row
without an entity or without a time has no place in any history: it stays, with no earlier rows, and
is nobody's earlier row. Rows that repeat an id are rows of their own; ties go by id, then by amount.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import count_if, ratio, time_axis
from ..functions.ordering import exact_quantiles
from ..functions.roles import Roles, forbid_columns, require_columns
from ..functions.session import materialized, shuffle_partitions

# --- fixed values: output column names and window widths in seconds ----------
WIDTHS = {"1h": 3600, "24h": 86400}
BASE_FEATURES = [
    "bhv_prev_txn_count", "bhv_prev_txn_count_log1p", "bhv_hist_mean_amt", "bhv_hist_std_amt",
    "bhv_hist_min_amt", "bhv_hist_max_amt", "bhv_time_since_prev_txn",
    "bhv_amt_to_hist_mean_ratio", "bhv_amt_diff_from_hist_mean", "bhv_amt_zscore",
]
# -----------------------------------------------------------------------------

HOT_ROWS = 5_000_000
MAX_LISTED = 100_000


def feature_names(widths=WIDTHS) -> list[str]:
    return BASE_FEATURES + [f"bhv_prior_count_{w}" for w in widths]


def derived_features(count: Column, mean: Column, std: Column, low: Column, high: Column,
                     gap_seconds: Column, amount: Column) -> list[Column]:
    """The ten base columns from the history moments; shared by batch paths."""
    spread = F.when(std != 0, std)
    return [
        count.cast("long").alias("bhv_prev_txn_count"),
        F.log1p(count).alias("bhv_prev_txn_count_log1p"),
        mean.alias("bhv_hist_mean_amt"), std.alias("bhv_hist_std_amt"),
        low.alias("bhv_hist_min_amt"), high.alias("bhv_hist_max_amt"),
        gap_seconds.cast("double").alias("bhv_time_since_prev_txn"),
        ratio(amount, mean).alias("bhv_amt_to_hist_mean_ratio"),
        (amount - mean).alias("bhv_amt_diff_from_hist_mean"),
        ratio(amount - mean, spread).alias("bhv_amt_zscore"),
    ]


def history_features(df: DataFrame, roles: Roles, widths: dict[str, int] = WIDTHS,
                     keep: Sequence[str] = (), hot_rows: int | None = HOT_ROWS,
                     forbid: Sequence[str] = ()) -> DataFrame:
    """``id``, the columns in ``keep`` and the ``bhv_*`` columns.

    Ordinary entities take one shuffle on the entity and one sort, shared by all windows. An
    entity with more than ``hot_rows`` rows would make one endless task; such entities are cut
    into time-ordered chunks and their history is carried from chunk to chunk.
    """
    need = [roles.id, roles.time, roles.entity, roles.amount]
    require_columns(df, need, "history_features")
    forbid_columns(df, forbid, "history_features")
    time, units = time_axis(df, roles.time)
    extra = [c for c in keep if c != roles.id]
    rows = df.select(F.col(roles.id).alias("__id"), time.alias("__t"), F.col(roles.entity).alias("__e"),
                     F.col(roles.amount).cast("double").alias("__a"),
                     *[F.col(c).alias(f"__k_{c}") for c in extra])
    spans = {name: seconds * units for name, seconds in widths.items()}

    def restore(out: DataFrame) -> DataFrame:
        return out.select(F.col("__id").alias(roles.id), *[F.col(f"__k_{c}").alias(c) for c in extra],
                          *feature_names(widths))

    if hot_rows is None:
        return restore(_window_history(rows, spans, units))
    placed = F.col("__e").isNotNull() & F.col("__t").isNotNull()
    counts = rows.where(placed).groupBy("__e").count().where(F.col("count") > hot_rows)
    found = counts.select(F.col("__e").alias("__hot")).take(MAX_LISTED + 1)
    if not found:
        return restore(_window_history(rows, spans, units))
    if len(found) <= MAX_LISTED:
        # the size is known: a short list of keys, at most n_rows / hot_rows of them
        n_hot, schema = len(found), counts.select(F.col("__e").alias("__hot")).schema
        keys = F.broadcast(rows.sparkSession.createDataFrame(found, schema))
    else:
        keys = materialized(counts.select(F.col("__e").alias("__hot")))
        n_hot = keys.count()
    is_hot = (F.col("__e") == F.col("__hot")) & placed
    cold = rows.join(keys, is_hot, "left_anti")
    busy = rows.join(keys, is_hot, "left_semi")
    return restore(_window_history(cold, spans, units)).unionByName(
        restore(_chunked_history(busy, spans, units, n_hot)))


def _window_history(rows: DataFrame, spans: dict[str, int], units: int) -> DataFrame:
    # rows without an entity or a time have no history: each is its own group instead of one huge group
    columns = rows.columns
    rows = rows.withColumn("__alone", F.when(F.col("__e").isNull() | F.col("__t").isNull(), F.monotonically_increasing_id()))
    w = Window.partitionBy("__e", "__alone").orderBy("__t", "__id", "__a")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    by_time = Window.partitionBy("__e", "__alone").orderBy("__t")
    # rows before the cut-off are subtracted: growing frames, no sliding re-aggregation
    older = [F.count(F.lit(1)).over(by_time.rangeBetween(Window.unboundedPreceding, -(span + 1))).alias(f"__older_{name}")
             for name, span in spans.items()]
    # each window value once, the arithmetic on top of it in a second projection
    moments = rows.select(
        "*", (F.row_number().over(w) - 1).cast("long").alias("__n"), F.avg("__a").over(prior).alias("__mean"),
        F.stddev_samp("__a").over(prior).alias("__std"), F.min("__a").over(prior).alias("__min"),
        F.max("__a").over(prior).alias("__max"), F.lag("__t").over(w).alias("__last"), *older)
    base = derived_features(F.col("__n"), F.col("__mean"), F.col("__std"), F.col("__min"), F.col("__max"),
                            (F.col("__t") - F.col("__last")) / F.lit(float(units)), F.col("__a"))
    older_than = lambda name: F.when(F.col("__t").isNull(), 0).otherwise(F.col(f"__older_{name}"))
    return moments.select(*columns, *base, *[
        (F.col("__n") - older_than(name)).alias(f"bhv_prior_count_{name}") for name in spans])


def _chunked_history(rows: DataFrame, spans: dict[str, int], units: int, n_hot: int) -> DataFrame:
    """History of hot entities without a task per entity.

    Each row also sends one probe per width to the position ``time - width``. Events and probes
    are range partitioned together on (entity, position, probe before event, id), which spreads a
    single entity over many partitions. Inside a partition ordinary windows do the work; what came
    before is a carry of one row per (entity, partition). A count at a probe is the number of rows
    too old for that width. A row is known by a number of its own, fixed when the copies are written,
    so that a repeated id stays as many rows as it has.
    """
    spark, n = rows.sparkSession, shuffle_partitions(rows.sparkSession)
    names = list(spans)
    payload = [c for c in rows.columns if c.startswith("__k_")]
    copies = F.array(
        F.struct(F.col("__t").alias("pos"), F.lit(1).alias("is_event"), F.lit(-1).alias("width")),
        *[F.struct((F.col("__t") - F.lit(spans[w])).alias("pos"), F.lit(0).alias("is_event"),
                   F.lit(i).alias("width")) for i, w in enumerate(names)])
    event = F.col("c.is_event") == 1
    spread = (rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("c", F.explode(copies))
              .select("__e", "__id", "__row", F.col("c.pos").alias("pos"), F.col("c.is_event").alias("is_event"),
                      F.col("c.width").alias("width"), F.when(event, F.col("__a")).alias("a"),
                      *[F.when(event, F.col(p)).alias(p) for p in payload])
              .repartitionByRange(n, "__e", "pos", "is_event", "__id", "a", "__row")
              .withColumn("chunk", F.spark_partition_id()))
    spread = materialized(spread)

    w = Window.partitionBy("__e", "chunk").orderBy("pos", "is_event", "__id", "a", "__row")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    event_time = F.when(F.col("is_event") == 1, F.col("pos"))
    local = spread.select(
        "*", F.coalesce(F.sum("is_event").over(prior), F.lit(0)).alias("l_n"),
        F.count("a").over(prior).alias("l_m"), F.avg("a").over(prior).alias("l_mean"),
        F.var_pop("a").over(prior).alias("l_var"), F.min("a").over(prior).alias("l_min"),
        F.max("a").over(prior).alias("l_max"), F.max(event_time).over(prior).alias("l_last"))

    time_type = spread.schema["pos"].dataType.simpleString()
    key_type = spread.schema["__e"].dataType.simpleString()
    partial = spread.groupBy("__e", "chunk").agg(
        F.sum("is_event").alias("n"), F.count("a").alias("m"), F.avg("a").alias("mean"),
        (F.var_pop("a") * F.count("a")).alias("m2"), F.min("a").alias("low"), F.max("a").alias("high"),
        F.max(event_time).alias("last"))
    # at most one row per partition and hot entity, so the group of an entity is small
    carry = partial.groupBy("__e").applyInPandas(
        _carry_forward, f"h_e {key_type}, h_chunk int, c_n long, c_m long, c_mean double, c_m2 double, "
                        f"c_min double, c_max double, c_last {time_type}")
    if n_hot + n <= 200_000:
        carry = F.broadcast(carry)
    joined = local.join(carry, (F.col("__e") == F.col("h_e")) & (F.col("chunk") == F.col("h_chunk")))

    m = F.col("c_m") + F.col("l_m")
    delta = F.col("l_mean") - F.col("c_mean")
    mean = (F.when(F.col("c_m") == 0, F.col("l_mean")).when(F.col("l_m") == 0, F.col("c_mean"))
            .otherwise(F.col("c_mean") + delta * F.col("l_m") / F.nullif(m, F.lit(0))))
    m2 = (F.coalesce(F.col("c_m2"), F.lit(0.0)) + F.coalesce(F.col("l_var") * F.col("l_m"), F.lit(0.0))
          + F.coalesce(delta * delta * F.col("c_m") * F.col("l_m") / F.nullif(m, F.lit(0)), F.lit(0.0)))
    low, high = F.least("c_min", "l_min"), F.greatest("c_max", "l_max")
    std = F.when(m >= 2, F.when(low == high, F.lit(0.0)).otherwise(F.sqrt(ratio(m2, m - 1))))
    total = F.col("c_n") + F.col("l_n")
    merged = joined.select(
        "__e", "__id", "__row", "width", "a", *payload, total.alias("n_before"), mean.alias("mean"), std.alias("std"),
        low.alias("low"), high.alias("high"),
        ((F.col("pos") - F.greatest("c_last", "l_last")) / F.lit(float(units))).alias("gap"))
    is_event = F.col("width") == -1
    columns = ["n_before", "mean", "std", "low", "high", "gap", "a", *payload]
    together = merged.groupBy("__row").agg(
        F.first("__e").alias("__e"), F.first("__id").alias("__id"), *[F.first(F.when(is_event, F.col(c)), ignorenulls=True).alias(c) for c in columns],
        *[F.max(F.when(F.col("width") == i, F.col("n_before"))).alias(f"older_{i}") for i in range(len(names))])
    return together.select(
        "__e", "__id", *payload,
        *derived_features(F.col("n_before"), F.col("mean"), F.col("std"), F.col("low"), F.col("high"),
                          F.col("gap"), F.col("a")),
        *[(F.col("n_before") - F.col(f"older_{i}")).cast("long").alias(f"bhv_prior_count_{w}")
          for i, w in enumerate(names)])


def _carry_forward(pdf: pd.DataFrame) -> pd.DataFrame:
    """History before each chunk of one entity, merged chunk by chunk (pairwise moments)."""
    out = []
    n = m = 0
    mean = m2 = low = high = last = None
    for r in pdf.sort_values("chunk").itertuples(index=False):
        out.append((r[0], r.chunk, n, m, mean, m2, low, high, last))
        n += int(r.n)
        if r.m:
            if m == 0:
                m, mean, m2, low, high = int(r.m), r.mean, r.m2, r.low, r.high
            else:
                d, both = r.mean - mean, m + int(r.m)
                m2 += r.m2 + d * d * m * r.m / both
                mean += d * r.m / both
                low, high, m = min(low, r.low), max(high, r.high), both
        if pd.notna(r.last):
            last = r.last if last is None else max(last, r.last)
    frame = pd.DataFrame(out, columns=["h_e", "h_chunk", "c_n", "c_m", "c_mean", "c_m2", "c_min", "c_max", "c_last"])
    floats = ["c_mean", "c_m2", "c_min", "c_max"]
    frame[floats] = frame[floats].astype("float64")
    if pdf["last"].dtype.kind in "iu":
        frame["c_last"] = frame["c_last"].astype("Int64")
    return frame


def history_diagnostics(features: DataFrame, entity: str, names: Sequence[str] | None = None) -> DataFrame:
    """Long table (metric, value) describing computed features: shares, quantiles, null rates."""
    names = list(names or [c for c in features.columns if c.startswith("bhv_")])
    n = F.count(F.lit(1))
    prev, gap, z = F.col("bhv_prev_txn_count"), F.col("bhv_time_since_prev_txn"), F.col("bhv_amt_zscore")
    single = features.agg(
        ratio(count_if(prev == 0), n).alias("cold_start_share"), F.min(prev).cast("double").alias("prev_count_min"),
        F.avg(prev).alias("prev_count_mean"), F.max(prev).cast("double").alias("prev_count_max"),
        ratio(count_if(gap.isNull()), n).alias("recency_missing_share"),
        ratio(count_if(F.abs(z) > 5), n).alias("extreme_zscore_share"),
        *[ratio(count_if(F.col(c).isNull()), n).alias(f"null_share_{c}") for c in names])
    # entities are counted after a group-by, not gathered in a distinct set
    entities = features.groupBy(entity).count().agg(
        F.count(entity).cast("double").alias("n_entities"),
        ratio(F.sum("count"), F.count(entity)).alias("rows_per_entity"))

    def melt(d):
        return d.unpivot([], d.columns, "metric", "value")

    long = features.select(F.explode(F.array(
        F.struct(F.lit("prev_count").alias("f"), prev.cast("double").alias("v")),
        F.struct(F.lit("recency").alias("f"), gap.alias("v")))).alias("s")).select("s.f", "s.v")
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75, 0.95], by=["f"])
    wanted = ~((F.col("f") == "recency") & F.col("prob").isin(0.25, 0.75))
    quantiles = q.where(wanted).select(
        F.concat(F.col("f"), F.format_string("_p%02d", F.round(F.col("prob") * 100).cast("int"))).alias("metric"),
        F.col("quantile").alias("value"))
    return melt(single).unionByName(melt(entities)).unionByName(quantiles)
