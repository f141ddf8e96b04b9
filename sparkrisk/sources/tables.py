"""Batch scans (S1), declared schemas (S2) and table validation (S3)."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.expressions import count_if
from ..functions.roles import Roles, require_columns


class TableValidationError(ValueError):
    """All problems found in a table, in one message."""


def read_transactions(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      fmt: str | None = None) -> DataFrame:
    """Read a CSV (with header), JSON or Parquet table; a missing path raises at once.

    With a declared schema nothing is inferred; Parquet carries its own schema.
    """
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet"
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            raise ValueError("CSV needs a declared schema; see sampled_schema()")
    return reader.format(fmt).load(path)


def sampled_schema(spark: SparkSession, path: str, sample_fraction: float = 0.01,
                   ids: Sequence[str] = ()) -> T.StructType:
    """Infer a CSV schema once from a sample of the rows, then narrow it.

    Key columns in ``ids`` stay as wide as inferred (at least long): narrowing them can overflow.
    """
    inferred = (spark.read.option("header", True).option("inferSchema", True)
                .option("samplingRatio", sample_fraction).csv(path).schema)
    return narrow_types(inferred, ids)


def narrow_types(schema: T.StructType, ids: Sequence[str] = ()) -> T.StructType:
    """Long -> int and double -> float, except for key columns, which become long."""
    def narrow(f: T.StructField) -> T.DataType:
        if f.name in ids:
            return T.LongType() if isinstance(f.dataType, T.IntegralType) else f.dataType
        if isinstance(f.dataType, T.LongType):
            return T.IntegerType()
        if isinstance(f.dataType, T.DoubleType):
            return T.FloatType()
        return f.dataType
    return T.StructType([T.StructField(f.name, narrow(f), True) for f in schema.fields])


def narrow_schema(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """The same rows with narrowed column types (casts in one projection).

    A long column with a value that an int can't hold stays long; one aggregate over the columns tells.
    """
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType) and f.name not in ids]
    wide = []
    if longs:
        ends = df.agg(*[F.min(c).alias(f"low_{c}") for c in longs], *[F.max(c).alias(f"high_{c}") for c in longs]).first()
        fits = lambda c: ends[f"low_{c}"] is None or (ends[f"low_{c}"] >= -2 ** 31 and ends[f"high_{c}"] < 2 ** 31)
        wide = [c for c in longs if not fits(c)]
    target = narrow_types(df.schema, [*ids, *wide])
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def validate_table(df: DataFrame, roles: Roles, strict: bool = False) -> DataFrame:
    """One row of checks: row count, duplicate ids, labels outside {0,1}, missing times.

    Duplicates are counted per id after map-side combining, so a repeated id never forms a group
    in memory. With ``strict`` every problem is listed in one error.
    """
    require_columns(df, [roles.id, roles.time, roles.label], "validate_table")
    numeric_time = isinstance(df.schema[roles.time].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType))
    label, time = F.col(roles.label), F.col(roles.time)
    per_id = df.groupBy(roles.id).agg(
        F.count(F.lit(1)).alias("n"), count_if(time.isNull()).alias("no_time"),
        count_if(label.isNotNull() & ~label.isin(0, 1)).alias("bad_label"))
    report = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).alias("n_duplicate_ids"),
        F.coalesce(F.sum("bad_label"), F.lit(0)).alias("n_bad_labels"),
        F.coalesce(F.sum("no_time"), F.lit(0)).alias("n_missing_time"),
    ).withColumn("time_is_numeric", F.lit(numeric_time))
    problems = F.filter(F.array(
        F.when(F.col("n_duplicate_ids") > 0, F.concat(F.col("n_duplicate_ids").cast("string"), F.lit(" duplicate id(s)"))),
        F.when(F.col("n_bad_labels") > 0, F.concat(F.col("n_bad_labels").cast("string"), F.lit(" label(s) outside {0,1}"))),
        F.when(F.col("n_missing_time") > 0, F.concat(F.col("n_missing_time").cast("string"), F.lit(" missing time(s)"))),
        F.when(~F.col("time_is_numeric"), F.lit("time column is not numeric")),
    ), lambda p: p.isNotNull())
    report = report.withColumn("problems", F.concat_ws("; ", problems))
    if strict:
        row = report.first()
        if row["problems"]:
            raise TableValidationError(f"table validation failed: {row['problems']}")
    return report
