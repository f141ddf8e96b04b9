"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_RUNS: list[str] = []


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="run-")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session (tests) may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return _local_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (stream checkpoints, intermediate tables)."""
    below = _RUNS[-1] if _RUNS else shared_dir(spark).rstrip("/")
    return f"{below}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Put everything written meanwhile into one folder of the shared one, and drop that at the end.

    Results that read from it must be written elsewhere, or collected, before the block ends.
    """
    path = scratch_path(spark, "run")
    _RUNS.append(path)
    try:
        yield path
    finally:
        _RUNS.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialized(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, fixed, and safe from lost executors.

    Columnar and compressed, so later plans read only the columns they need; ranks and partition
    numbers in it never change, however often it is read.
    """
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
