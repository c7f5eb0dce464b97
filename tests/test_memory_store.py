"""Saves of the answer memory: commits, snapshots, what a failure leaves."""

import pytest
from pyspark.sql import functions as F

from convlytics.session import scratch_path
from convlytics.sources.memory_store import append_memory, commits, load_memory

SCHEMA = "item_id string, text string, metadata map<string,string>, embedding array<double>"


def items(spark, *texts):
    return spark.createDataFrame([(f"i{i}", t, {"thread_id": "t"}, [1.0, 2.0]) for i, t in enumerate(texts)], SCHEMA)


def texts(df):
    return sorted(r.text for r in df.collect())


def test_reads_have_no_exchange_and_are_snapshots(spark):
    path = scratch_path(spark, "mem")
    assert load_memory(spark, path).count() == 0
    append_memory(items(spark, "a", "b"), path, "s1")
    before = load_memory(spark, path)
    append_memory(items(spark, "c"), path, "s2")
    assert texts(before) == ["a", "b"] and texts(load_memory(spark, path)) == ["a", "b", "c"]
    assert texts(load_memory(spark, path, ["s2"])) == ["c"]
    plan = load_memory(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_a_repeated_batch_writes_nothing(spark):
    path = scratch_path(spark, "mem")
    append_memory(items(spark, "a"), path, "s1")
    folder = commits(spark, path)["s1"]
    failing = items(spark, "other").withColumn("text", F.raise_error(F.lit("not evaluated")).cast("string"))
    assert append_memory(failing, path, "s1") == "s1"
    assert commits(spark, path) == {"s1": folder} and texts(load_memory(spark, path)) == ["a"]


def test_a_half_written_save_is_not_seen(spark):
    path = scratch_path(spark, "mem")
    append_memory(items(spark, "a"), path, "s1")
    rows = items(spark, *"bcdefgh").repartition(4)
    broken = rows.withColumn("text", F.when(F.col("text") == "h", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        append_memory(broken, path, "s2")
    # files of an attempt that ended before its commit
    rows.withColumn("save_id", F.lit("s2")).write.parquet(f"{path}/data/dead")
    assert texts(load_memory(spark, path)) == ["a"]
    append_memory(rows, path, "s2")
    assert texts(load_memory(spark, path)) == sorted("abcdefgh")


def test_of_two_commits_of_one_save_the_first_counts(spark):
    path = scratch_path(spark, "mem")
    append_memory(items(spark, "a"), path, "s1")
    items(spark, "late").withColumn("save_id", F.lit("s1")).write.parquet(f"{path}/data/late")
    spark.createDataFrame([("s1", "late", 2**62)], "save_id string, attempt string, committed_ns long").write.mode("append").parquet(f"{path}/commits")
    assert texts(load_memory(spark, path)) == ["a"]


def test_equal_items_of_a_batch_are_saved_once(spark):
    path = scratch_path(spark, "mem")
    append_memory(items(spark, "a").union(items(spark, "a")), path)
    assert texts(load_memory(spark, path)) == ["a"]
