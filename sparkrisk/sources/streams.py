"""Stream sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Files as a stream; the limit bounds the size of a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType,
                 max_offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """JSON messages of a topic; needs the public spark-sql-kafka package on the class path."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets_per_trigger)
           .option("failOnDataLoss", True).load())
    return parse_messages(raw.select(F.col("value").cast("string").alias("raw")), schema)


def parse_messages(df: DataFrame, schema: T.StructType, raw: str = "raw", label: str | None = None) -> DataFrame:
    """JSON text -> columns, keeping the text; ``has_label`` is tested before parsing drops it."""
    parsed = df.withColumn("__m", F.from_json(raw, schema))
    has_label = F.get_json_object(raw, f"$.{label}").isNotNull() if label else F.lit(False)
    return parsed.select(raw, has_label.alias("has_label"), "__m.*")


def decision_columns(df: DataFrame, id_col: str, policy_version: str) -> DataFrame:
    """The published decision record."""
    return df.select(F.col(id_col).alias("transaction_id"), F.col("score").alias("risk_score"),
                     "decision", F.lit(policy_version).alias("policy_version"))


def dead_letters(df: DataFrame, error: str = "error_reason") -> DataFrame:
    """Rejected rows as (original_transaction JSON, error)."""
    body = [c for c in df.columns if c != error]
    return df.where(F.col(error).isNotNull()).select(
        F.to_json(F.struct(*body)).alias("original_transaction"), F.col(error).alias("error"))


def split_sink(valid_path: str, dead_path: str, error: str = "error_reason",
               transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: valid rows to one table, rejected rows to another.

    Each micro-batch overwrites its own folder, so a replayed batch writes the same rows again
    instead of adding them twice. The batch is read twice from the source, never collected.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        valid = batch.where(F.col(error).isNull()).drop(error)
        if transform is not None:
            valid = transform(valid)
        valid.write.mode("overwrite").parquet(f"{valid_path}/epoch={epoch}")
        dead_letters(batch, error).write.mode("overwrite").parquet(f"{dead_path}/epoch={epoch}")
    return write


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Run everything available, finish the batch in flight and stop (bounded run)."""
    query = (df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def publish_decisions(decisions: DataFrame, servers: str, topic: str, checkpoint: str):
    """Decision records as JSON messages keyed by transaction id; needs the public Kafka package."""
    messages = decisions.select(F.col("transaction_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return (messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).outputMode("append").start())
