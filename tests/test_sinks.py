"""Sinks under failure, self-reading plans and retries."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from marketfold.sources import sinks


def test_a_failing_refresh_leaves_the_content(spark, frame, tmp_path):
    target = str(tmp_path / "t")
    sinks.full_refresh(frame("a int", (1,), (2,)), target)
    broken = frame("a int", (3,), (4,)).withColumn("a", F.when(F.col("a") == 4, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("a")))
    with pytest.raises(Exception, match="stop"):
        sinks.full_refresh(broken, target)
    assert rows(sinks.current(spark, target)) == [(1,), (2,)]


def test_a_refresh_may_read_what_it_replaces(spark, frame, tmp_path):
    target = str(tmp_path / "t")
    sinks.full_refresh(frame("a int", (1,), (2,)), target)
    for factor in (10, 10, 10):
        out = sinks.full_refresh(sinks.current(spark, target).withColumn("a", F.col("a") * factor), target)
    assert rows(out) == [(1000,), (2000,)]
    assert sum(name.startswith("v-") for name in os.listdir(target)) == 2  # older versions are gone


def test_a_reader_of_the_old_version_goes_on(spark, frame, tmp_path):
    target = str(tmp_path / "t")
    old = sinks.full_refresh(frame("a int", (1,)), target)
    sinks.full_refresh(frame("a int", (2,)), target)
    assert rows(old) == [(1,)] and rows(sinks.current(spark, target)) == [(2,)]


def test_a_table_may_be_created_from_itself(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    sinks.create_as(frame("a int", (1,), (2,)), "self_read_test", path)
    out = sinks.create_as(spark.table("self_read_test").where("a > 1"), "self_read_test", path)
    assert rows(out) == [(2,)] and rows(spark.table("self_read_test")) == [(2,)]
    with pytest.raises(Exception, match="stop"):
        sinks.create_as(spark.table("self_read_test").select(F.raise_error(F.lit("stop")).cast("int").alias("a")), "self_read_test", path)
    assert rows(spark.table("self_read_test")) == [(2,)]


def test_a_retry_logs_a_run_once(spark, tmp_path):
    target = str(tmp_path / "log")
    for _ in range(2):
        out = sinks.append_run_log(spark, target, "SUCCESS", "x", "2025-01-01 00:00:00")
    assert out.count() == 1
    with pytest.raises(ValueError, match="logged already"):
        sinks.append_run_log(spark, target, "FAILURE", "x", "2025-01-01 00:00:00")
    assert sinks.append_run_log(spark, target, "FAILURE", "x", "2025-01-02 00:00:00").count() == 2


def test_a_run_owns_its_folder(spark, frame):
    with sinks.run_folder(spark) as folder:
        assert rows(sinks.stage(frame("a int", (1,)), "step")) == [(1,)]
        assert len(os.listdir(folder)) == 1
    assert not os.path.exists(folder)


def test_a_written_step_leaves_no_shuffle_files(spark):
    from concurrent.futures import ThreadPoolExecutor
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    def step(k):
        sums = spark.range(0, 20_000, 1, 4).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
        other = spark.range(0, 100, 1, 3).withColumnRenamed("id", "k").repartition(3, "k")
        return sinks.stage(sums.join(other.hint("merge"), "k").withColumn("k", F.col("k") * k), "step")

    before = files()
    with ThreadPoolExecutor(2) as pool:
        steps = list(pool.map(step, (1, 2, 3)))
    assert files() <= before
    assert [s.agg(F.sum("s"), F.max("k")).first() for s in steps] == [(199_990_000, 99 * k) for k in (1, 2, 3)]
    # Settings are as before, also after a write that failed; other actions keep theirs.
    with pytest.raises(Exception, match="stop"):
        sinks.stage(spark.range(1).select(F.raise_error(F.lit("stop")).cast("int").alias("a")), "step")
    assert spark.conf.get(sinks.FREE_SHUFFLES) == "false"
    twice = spark.range(0, 1_000, 1, 4).groupBy((F.col("id") % 10).alias("k")).count()
    assert rows(twice) == rows(twice) and files() - before
