"""Artifacts (S7) and entity-state snapshots (S8) as plain Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_artifact(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def read_artifact(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def snapshot_state(state: DataFrame, path: str) -> str:
    """Persist an entity-state table (see operators.state); restored as a stream's initial state."""
    return write_artifact(state, path)


def restore_state(spark: SparkSession, path: str) -> DataFrame:
    return read_artifact(spark, path)
