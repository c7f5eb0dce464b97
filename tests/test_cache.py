"""Layout of the embedding cache: buckets, what is read, compaction."""

import re

import pytest
from pyspark.sql import functions as F

from convlytics.functions.embedders import DigestEmbedder
from convlytics.operators.embed import cache_misses, chunk_texts, fill_cache
from convlytics.session import scratch_path
from convlytics.sources import cache as C


def chunks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return chunk_texts(df, "id", "t", chunk_size=3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def filled(spark):
    path, emb = scratch_path(spark, "cache"), DigestEmbedder()
    fill_cache(spark, chunks(spark, [f"text {i}" for i in range(500)]), path, emb, "m1")
    fill_cache(spark, chunks(spark, [f"text {i}" for i in range(400, 600)]), path, emb, "m1")
    fill_cache(spark, chunks(spark, ["text 1", "text 2"]), path, emb, "m2")
    return path, emb


def test_each_key_once_for_each_model(spark, filled):
    path, emb = filled
    assert C.load_cache(spark, path, "m1").count() == 600 and C.load_cache(spark, path).count() == 602
    assert C.cache_rows(spark, path).count() == 602  # nothing was embedded twice
    assert fill_cache(spark, chunks(spark, [f"text {i}" for i in range(700)]), path, emb, "m1").count() == 100
    got = {r.text_hash: r.embedding for r in C.load_cache(spark, path, "m2").collect()}
    assert sorted(got.values()) == sorted(emb(["text 1", "text 2"]))
    assert C.load_cache(spark, scratch_path(spark, "none"), "m").count() == 0


def test_the_cache_side_has_no_exchange(spark, filled):
    path, _ = filled
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = C.load_cache(spark, path, "m1")
        assert "Exchange" not in plan(cache)
        misses = cache_misses(chunks(spark, [f"text {i}" for i in range(900)]), cache, "m1")
        lines = plan(misses).split("\n")
        scan = next(i for i, line in enumerate(lines) if "text_hash" in line and "FileScan parquet" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
        above = [line for i, line in enumerate(lines) if i < scan and depth(line) < depth(lines[scan])
                 and not any(depth(x) <= depth(line) for x in lines[i + 1:scan])]
        assert any("Join" in line for line in above) and not any("Exchange" in line for line in above)
        assert misses.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_lookup_of_few_hashes_reads_their_buckets_only(spark):
    path = scratch_path(spark, "cache")
    rows = chunks(spark, [f"text {i}" for i in range(300)]).select(
        F.lit("m").alias("model"), "text_hash", F.array(F.lit(1.0)).alias("embedding"))
    C.append_cache(rows, path, buckets=16)
    few = [r.text_hash for r in rows.limit(3).collect()]
    found = C.load_cache(spark, path, "m", few)
    kept, of = map(int, re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan(found)).groups())
    assert of == 16 and 1 <= kept <= 3 and sorted(r.text_hash for r in found.collect()) == sorted(few)
    assert C.load_cache(spark, path, "m", []).count() == 0


def test_compaction_leaves_each_key_in_one_file_a_bucket(spark):
    path = scratch_path(spark, "cache")
    rows = chunks(spark, [f"text {i}" for i in range(60)]).select(
        F.lit("m").alias("model"), "text_hash", F.array(F.lit(1.0)).alias("embedding"))
    for _ in range(3):
        C.append_cache(rows, path, buckets=4)
    assert C.cache_rows(spark, path).count() == 180 and len(C.cache_rows(spark, path).inputFiles()) == 12
    before = C.load_cache(spark, path, "m")
    for n in (None, 2, None):
        C.compact_cache(spark, path, n)
        if n is None and before is not None:
            assert before.count() == 60  # a reader that began before still has its files
            before = None
        assert C.cache_rows(spark, path).count() == 60 == C.load_cache(spark, path, "m").count()
    assert len(C.cache_rows(spark, path).inputFiles()) == 2
    C.append_cache(rows, path)
    assert C.load_cache(spark, path).count() == 60 and C.cache_rows(spark, path).count() == 120


def test_a_compaction_that_failed_is_not_seen(spark):
    path = scratch_path(spark, "cache")
    rows = spark.createDataFrame([("m", "aa", [1.0])], "model string, text_hash string, embedding array<float>")
    C.append_cache(rows, path, buckets=2)
    C._write(rows.withColumn("batch_id", F.lit("x")), C._table(spark, path, 1, 2), 2)  # written, not named in the layout
    assert [r.batch_id for r in C.cache_rows(spark, path).collect()] == [None]
    C.compact_cache(spark, path)
    assert [r.batch_id for r in C.cache_rows(spark, path).collect()] == [None]
