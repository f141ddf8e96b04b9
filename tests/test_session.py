"""Scratch tables: one folder a run, dropped with it."""

import os

from pyspark.sql import functions as F

from sparkrisk.functions.session import materialized, scratch_path, scratch_run


def test_a_run_drops_what_it_wrote(spark):
    with scratch_run(spark) as folder:
        kept = materialized(spark.range(10).withColumn("x", F.rand(1)))
        assert kept.count() == 10 and scratch_path(spark, "a").startswith(folder)
        assert os.listdir(folder)
    assert not os.path.exists(folder)
    assert not scratch_path(spark, "a").startswith(folder)


def test_rows_stay_as_written(spark):
    df = materialized(spark.range(100).withColumn("x", F.rand()))
    assert df.agg(F.sum("x")).first() == df.agg(F.sum("x")).first()
