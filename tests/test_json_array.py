"""JSON array files, cut into blocks of a few bytes."""

import json
import os
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.base import PySparkException

from convlytics.errors import DataValidationError
from convlytics.operators.master import clean_messages
from convlytics.session import scratch_path
from convlytics.sources import json_array as A
from convlytics.sources.json_source import load_collections, read_json


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "16", "spark.sql.files.minPartitionNum": "64"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(spark, *files):
    path = scratch_path(spark, "array")
    os.makedirs(path)
    for i, f in enumerate(files):
        with open(os.path.join(path, f"{i}.json"), "w", encoding="utf-8", newline="") as out:
            out.write(f)
    return path


def some_record(rng, deep=0):
    text = "".join(rng.choice('ab{}[],:"\\\n é日😀') for _ in range(rng.randrange(12)))
    pick = rng.randrange(8 if deep < 3 else 6)
    if pick == 6:
        return [some_record(rng, deep + 1) for _ in range(rng.randrange(3))]
    if pick == 7:
        return {text: some_record(rng, deep + 1), "k": text}
    return [text, rng.randrange(-9, 99), 1.5e20, None, {}, "\\" * rng.randrange(4)][pick]


@pytest.mark.parametrize("seed", range(4))
def test_records_come_back_as_they_are(spark, small_blocks, seed):
    rng = random.Random(seed)
    files, want = [], []
    for _ in range(3):
        rows = [{"id": i, "v": some_record(rng), "w": some_record(rng)} for i in range(rng.choice([0, 1, 40]))]
        texts = [json.dumps(r, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 2])) for r in rows]
        gap = rng.choice(["", " ", "\r\n\t"])
        files.append(f"{gap}[{gap}" + f"{gap},{gap}".join(texts) + f"{gap}]{gap}")
        want += texts
    path = write(spark, *files)
    records = A.array_records(spark, path)
    assert sorted(r.value for r in records.collect()) == sorted(want)
    if len(want) > 30:
        assert A._pieces(spark, path).rdd.getNumPartitions() > 4


def test_filters_above_the_records_do_not_meet_their_parts(spark, small_blocks):
    rows = [{"a": i, "n": {"t": "x" * (i % 60)}} for i in range(200)]
    path = write(spark, "[" + " , ".join(map(json.dumps, rows)) + " ]")
    df = read_json(spark, path, "a int, n struct<t string>", multiline=True)
    assert df.where("n.t is not null and n.t like 'x%' and a >= 0").count() == sum(1 for r in rows if r["n"]["t"])


def test_one_record_over_many_blocks(spark, small_blocks):
    record = json.dumps({"a": [{"x": i, "t": "}{" * 5} for i in range(100)], "b": "é" * 300})
    path = write(spark, f"[{record},\n{record}]")
    assert [r.value for r in A.array_records(spark, path).collect()] == [record] * 2


BAD = ['[{"a": 1}', '[{"a": 1}}]', '[{"a": 1},]', '[,{"a": 1}]', '[{"a": 1} {"a": 2}]', '[{"a": 1}] x', '[{"a": 1}]]',
       'x[{"a": 1}]', '{"a": 1}, {"a": 2}', '{"a": 1}\n{"a": 2}', '{"a": 1', '[{"a": "1}]', '[1, 2]', '[{"a": 1}] [{"a": 2}]', '[{"a": 1}x]', '[{"a": 1},,{"a": 2}]', '[{"a": oops}]', '[{"a": 1]]',
       '[[{"a": 1}]]', '["a"]', '{"a": [1]}]', '[{"a": 1}}']


@pytest.mark.parametrize("text", BAD)
def test_malformed_files_raise(spark, small_blocks, text):
    with pytest.raises((DataValidationError, PySparkException, Py4JJavaError)):
        read_json(spark, write(spark, text), "a int", multiline=True).collect()


@pytest.mark.parametrize("text", [BAD[0], BAD[4], '[{"a": oops}]', "[1, 2]"])
def test_malformed_collections_raise_when_they_are_loaded(spark, small_blocks, text):
    text = text.replace("[", "[" + '{"a": 3}, ' * 20, 1)
    with pytest.raises(DataValidationError):
        load_collections(spark, write(spark, '[{"thread_id": "1"}]'), write(spark, text), multiline=True, messages_schema="a int")


def test_a_file_may_be_one_object(spark, small_blocks):
    record = json.dumps({"a": [{"x": i, "t": "}{,"} for i in range(40)], "b": 1}, indent=1)
    path = write(spark, f" {record} \n", '[{"b": 2}]', '{"b": 3}')
    assert sorted(r.b for r in read_json(spark, path, "b int", multiline=True).collect()) == [1, 2, 3]
    assert record in [r.value for r in A.array_records(spark, path).collect()]


def test_nothing_but_white_space_and_empty_arrays(spark, small_blocks):
    assert A.array_records(spark, write(spark, "[]", " [ \n ] ", "", " \n")).collect() == []
    with pytest.raises(FileNotFoundError):
        read_json(spark, scratch_path(spark, "none"), "a int", multiline=True)


def test_key_order_numbers_and_inferred_threads(spark, small_blocks):
    t = write(spark, json.dumps([{"thread_id": "001", "n": 1, "deep": {"x": [1.5]}}, {"thread_id": "002", "status": "open"}]))
    m = write(spark, '[{"thread_id": "001", "content": {"z": 1, "a": 12345678.9}, "created_at": {"$date": "2024-01-01T00:00:00Z"}},\n'
                     ' {"content": ["a}", 1.0, true], "thread_id": "001"}, {"thread_id": "002", "content": "{\\"b\\": \\"日\\"}"}]')
    threads, messages = load_collections(spark, t, m, multiline=True)
    assert sorted(threads.columns) == ["deep", "n", "status", "thread_id"] and threads.where("deep.x[0] = 1.5").count() == 1
    got = sorted(r.clean_content for r in clean_messages(messages).collect())
    assert got == ["a}; 1.0; true", '{"b": "日"}', '{"z":1,"a":1.23456789E7}'] or got[2].startswith('{"z":1,"a":1')


def test_records_are_parsed_once(spark):
    """What is validated is what later reads use: the text files are not in the plan."""
    t, m = write(spark, '[{"thread_id": "1"}]'), write(spark, '[{"thread_id": "1", "content": 2}]')
    _, messages = load_collections(spark, t, m, multiline=True)
    plan = messages._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "text" not in plan.lower().replace("context", "")


def test_a_large_array_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from convlytics.plans import catalog

    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    e = spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"),
                                 when.alias("ts"), F.lit(1.5).alias("value"), F.lit('{"k": 1}').alias("props"))
    e.repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "ARRAY_BYTES", 100_000, raising=False)
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    assert catalog.src_json_array(spark, str(tmp_path)).count() == 3000
    made = [x for x in os.listdir(spark.conf.get("spark.checkpoint.dir")) if x.startswith("events-array") and x not in before]
    files = [x for x in os.listdir(os.path.join(spark.conf.get("spark.checkpoint.dir"), made[0])) if x.startswith("part-")]
    assert len(files) >= 4
