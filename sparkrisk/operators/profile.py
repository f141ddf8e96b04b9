"""Column schema (P1, P2) and table profiling."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.expressions import count_if, ratio, time_axis
from ..functions.ordering import asc, exact_quantiles, keys_at_ranks
from ..functions.session import materialized
from ..functions.roles import Roles

# --- fixed values: feature groups by column-name pattern, first match wins ----
GROUP_PATTERNS = [
    ("product", r"ProductCD"), ("card", r"card\d+"), ("addr", r"addr\d+"), ("distance", r"dist[12]"),
    ("email", r".*emaildomain.*"), ("C", r"C\d+"), ("D", r"D\d+"), ("M", r"M\d+"), ("V", r"V\d+"),
    ("identity", r"id_\d+"), ("device", r"DeviceType|DeviceInfo"),
]
# -----------------------------------------------------------------------------


def feature_group(name: Column, roles: Roles, patterns: Sequence[tuple[str, str]] = GROUP_PATTERNS) -> Column:
    c = (F.when(name == roles.id, "id").when(name == roles.label, "target")
         .when(name == roles.time, "time").when(name == roles.amount, "amount"))
    for group, pattern in patterns:
        c = c.when(name.rlike(f"^(?:{pattern})$"), group)
    return c.otherwise("other")


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(name, null_rate) for every column from a single aggregation over the table."""
    columns = list(columns or df.columns)
    n = F.count(F.lit(1))
    one = df.agg(*[ratio(n - F.count(F.col(c)), n).alias(c) for c in columns])
    return one.unpivot([], columns, "name", "null_rate")


def feature_schema(train: DataFrame, roles: Roles,
                   patterns: Sequence[tuple[str, str]] = GROUP_PATTERNS) -> DataFrame:
    """One row per column: type, numeric or categorical, group, train null rate, used or why not."""
    excluded = {roles.id: "identifier", roles.label: "target", roles.time: "raw time"}
    kinds = [(f.name, f.dataType.simpleString(),
              "numeric" if isinstance(f.dataType, T.NumericType) else "categorical",
              f.name not in excluded, excluded.get(f.name)) for f in train.schema.fields]
    static = train.sparkSession.createDataFrame(
        kinds, "name string, dtype string, value_type string, used boolean, exclusion_reason string")
    return (null_rates(train).join(static, "name")
            .withColumn("feature_group", feature_group(F.col("name"), roles, patterns))
            .select("name", "dtype", "value_type", "feature_group", "null_rate", "used", "exclusion_reason"))


def feature_schema_summary(schema: DataFrame) -> DataFrame:
    """Totals and used columns by group as (metric, value) rows."""
    used = F.col("used")
    totals = schema.agg(
        F.count(F.lit(1)).alias("n_total"), count_if(used).alias("n_used"), count_if(~used).alias("n_excluded"),
        count_if(used & (F.col("value_type") == "numeric")).alias("n_numeric_used"),
        count_if(used & (F.col("value_type") == "categorical")).alias("n_categorical_used"))
    groups = schema.where(used).groupBy("feature_group").agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("used_in_"), F.col("feature_group")).alias("metric"), "value")
    return totals.unpivot([], totals.columns, "metric", "value").unionByName(groups)


def structure_report(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows, columns, duplicate ids, class counts, positive rate (A1)."""
    y = F.col(roles.label)
    per_id = df.groupBy(roles.id).agg(F.count(F.lit(1)).alias("n"), count_if(y == 1).alias("pos"),
                                      count_if(y == 0).alias("neg"))
    return per_id.agg(F.sum("n").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
                      (F.sum("n") - F.count(F.lit(1))).alias("n_duplicate_ids"), F.sum("neg").alias("n_negative"),
                      F.sum("pos").alias("n_positive"),
                      ratio(F.sum("pos"), F.sum("pos") + F.sum("neg")).alias("positive_rate"))


def temporal_bins(df: DataFrame, roles: Roles, bins: int = 20) -> DataFrame:
    """Volume and positive rate in equal-width time bins, right-closed, lowest included (A2)."""
    t, _ = time_axis(df, roles.time)
    narrow = df.select(t.alias("t"), F.col(roles.label).alias("y"))
    ends = narrow.agg(F.min("t"), F.max("t")).first()  # two scalars
    if ends[0] is None:
        raise ValueError("temporal_bins: no rows")
    low, span = ends[0], ends[1] - ends[0]
    position = F.ceil((F.col("t") - F.lit(low)).cast("double") * bins / F.lit(float(span or 1)))
    index = F.greatest(F.lit(1), F.least(F.lit(bins), position)).cast("int")
    return (narrow.where(F.col("t").isNotNull()).groupBy(index.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("y").cast("double")).alias("positive_rate")))


def temporal_summary(df: DataFrame, roles: Roles, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Range of the time axis and the boundary times of the chronological split (A2); rows without a time are left out."""
    t, units = time_axis(df, roles.time)
    keyed = df.select(t.alias("t"), F.col(roles.id).alias("id"))
    n, keys = keys_at_ranks(keyed, [asc("t"), asc("id")],
                            lambda n: [1, n, int(n * train), int(n * (train + val))])
    seconds = [None if k is None else k["t"] / units for k in keys]
    first, last, train_end, val_end = seconds
    span = None if first is None else last - first
    row = (n, first, last, span, None if span is None else round(span / 86400, 1), train_end, val_end)
    return df.sparkSession.createDataFrame(
        [row], "n_rows long, time_min double, time_max double, range_seconds double, range_days double, "
               "train_end_time double, val_end_time double")


def missingness_by_group(schema: DataFrame, top: int = 5) -> DataFrame:
    """Mean, max, min null rate per feature group and its most-missing columns (A3).

    Input: (name, feature_group, null_rate), one row per column, so groups are small.
    """
    w = Window.partitionBy("feature_group").orderBy(F.desc("null_rate"), "name")
    ranked = schema.withColumn("__r", F.row_number().over(w))
    return ranked.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("n_columns"), F.avg("null_rate").alias("mean_null_rate"),
        F.max("null_rate").alias("max_null_rate"), F.min("null_rate").alias("min_null_rate"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("__r") <= top, F.struct(F.col("__r").alias("r"), F.col("name").alias("c"))))),
            lambda s: s["c"]), ",").alias("most_missing"))


def entity_key_profile(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """Cardinality and rows per key of candidate entity keys; NULL components are set aside (A4).

    All candidates are grouping sets of one aggregation, so the table is scanned once and keys keep their types.
    """
    sets = {"+".join(keys): list(keys) for keys in candidates}
    columns = list(dict.fromkeys(k for keys in sets.values() for k in keys))
    # bit by bit from the first column: 1 where the set leaves it out
    which = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for name, keys in sets.items()}
    named = functools.reduce(lambda c, n: c.when(F.col("__set") == which[n], F.lit(n)), list(which)[1:], F.when(F.col("__set") == which[next(iter(which))], F.lit(next(iter(which)))))
    whole = functools.reduce(operator.and_, [F.col(c).isNotNull() | ((F.shiftright(F.col("__set"), len(columns) - 1 - i) % 2) == 1) for i, c in enumerate(columns)])
    grouped = df.groupingSets([[F.col(k) for k in keys] for keys in sets.values()], *[F.col(c) for c in columns])
    sizes = grouped.agg(F.count(F.lit(1)).alias("c"), F.grouping_id().alias("__set"))
    sizes = materialized(sizes.select(named.alias("entity_key"), "c", whole.alias("whole")))
    empty = df.sparkSession.createDataFrame([(n,) for n in sets], "entity_key string")  # one row per candidate, also of an empty table
    totals = empty.join(sizes.groupBy("entity_key").agg(F.sum("c").alias("n_rows"), F.sum(F.when(~F.col("whole"), F.col("c")).otherwise(0)).alias("n_null_key")), "entity_key", "left")
    totals = totals.fillna(0, ["n_rows", "n_null_key"])
    sizes = sizes.where("whole")
    stats = sizes.groupBy("entity_key").agg(
        F.count(F.lit(1)).alias("cardinality"), F.avg("c").alias("mean_rows"), F.max("c").alias("max_rows"),
        ratio(count_if(F.col("c") == 1), F.count(F.lit(1))).alias("singleton_share"))
    median = exact_quantiles(sizes, "c", [0.5], by=["entity_key"]).select(
        "entity_key", F.col("quantile").alias("median_rows"))
    return (totals.join(stats, "entity_key", "left").join(median, "entity_key", "left")
            .select("entity_key", "n_rows", "n_null_key", "cardinality", "median_rows", "mean_rows",
                    "max_rows", "singleton_share"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, the weight of a positive row."""
    y = F.col(label)
    return df.agg(count_if(y == 0).alias("n_negative"), count_if(y == 1).alias("n_positive"),
                  ratio(count_if(y == 0), count_if(y == 1)).alias("positive_weight"))
