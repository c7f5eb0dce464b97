"""Sources and stores: JSON collections, master read-through, metrics CSV, models."""

import json
import os

import pytest
from pyspark.sql import functions as F

from convlytics.errors import DataValidationError
from convlytics.operators.metrics import top_values_json
from convlytics.operators.profile import preview, shape
from convlytics.operators.schema import require_rows
from convlytics.session import scratch_path
from convlytics.sources.json_source import load_collections
from convlytics.sources.stores import load_model, master_read_through


def _write(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.json"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def test_load_collections_reads_variant_fields(spark):
    t, m = scratch_path(spark, "t"), scratch_path(spark, "m")
    _write(t, [json.dumps({"thread_id": "001", "status": "open"})])
    _write(m, [json.dumps({"thread_id": "001", "content": ["a", 1], "created_at": {"$date": "2024-01-01T00:00:00Z"}}),
               json.dumps({"thread_id": "001", "content": {"k": "v"}, "created_at": "2024-01-02"})])
    threads, msgs = load_collections(spark, t, m)
    assert threads.first().thread_id == "001"
    assert dict(msgs.dtypes)["content"] == "variant" and msgs.count() == 2


def test_load_collections_errors(spark):
    t, m = scratch_path(spark, "t"), scratch_path(spark, "m")
    with pytest.raises(FileNotFoundError):
        load_collections(spark, t, m)
    _write(t, [json.dumps({"thread_id": "1"})])
    _write(m, [])
    with pytest.raises(DataValidationError):
        load_collections(spark, t, m)
    bad = scratch_path(spark, "bad")
    _write(bad, ['{"thread_id": "1", "content": '])
    with pytest.raises(DataValidationError):
        load_collections(spark, t, bad)
    _write(bad, ['{"thread_id": "1", "content": "fine"}'] * 50 + ["{oops"])
    with pytest.raises(DataValidationError):
        load_collections(spark, t, bad)
    whole = scratch_path(spark, "whole")
    _write(whole, ["[", '{"thread_id": "1", "content": ["x", 1.5e20],', '"created_at": null}', "]"])
    assert load_collections(spark, t, whole, multiline=True)[1].count() == 1
    _write(whole, ["[", '{"thread_id": "1", "content": '])
    with pytest.raises(DataValidationError):
        load_collections(spark, t, whole, multiline=True)


def test_source_key_order_and_repeated_keys(spark):
    from convlytics.operators.master import clean_messages

    t, m = scratch_path(spark, "t"), scratch_path(spark, "m")
    _write(t, [json.dumps({"thread_id": "1"})])
    _write(m, ['{"thread_id": "1", "content": {"b": 1, "a": 12345678.9}}', '{"thread_id": "1", "content": {"k": 1, "k": 2}}',
               '{"thread_id": "1", "content": 0.0001}', '{"thread_id": "1", "content": "{\\"z\\": 1}"}'])
    got = [r.clean_content for r in clean_messages(load_collections(spark, t, m)[1]).collect()]
    assert got[0].startswith('{"b":1,"a":1') and got[1] in ('{"k":2}', '{"k":1,"k":2}')
    assert got[2:] == ["0.0001", '{"z": 1}']


def test_master_read_through_uses_saved_copy(spark):
    path = scratch_path(spark, "master")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", 1)], "thread_id string, msg_count long")

    first = master_read_through(spark, path, build)
    again = master_read_through(spark, path, build)
    assert first.count() == again.count() == 1 and len(calls) == 1
    master_read_through(spark, path, build, force_rebuild=True)
    assert len(calls) == 2


def test_missing_model_version(spark):
    with pytest.raises(FileNotFoundError):
        load_model(spark, scratch_path(spark, "models"), "v9")


def test_small_helpers(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "s string")
    assert top_values_json(df, "s", 5).first().estado_top == '{"a":2,"b":1}'
    assert preview(df, 2).count() == 2
    r = shape(df).first()
    assert (r.n_rows, r.n_columns) == (4, 1)
    with pytest.raises(DataValidationError):
        require_rows(df.filter(F.lit(False)), "empty")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import convlytics.session as S

    class Context:
        master = "spark://head:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.checkpoint_dir(Session())


def test_column_names_by_rule(spark):
    from convlytics.operators.schema import snake_case

    names = {" C Custkey": "c_custkey", "c-name": "c_name", "C__Mkt  Segment!": "c_mkt_segment", "a - b": "a_b", "_x_": "_x_",
             "a!-!b": "a_b", "ÁbC9": "bc9", "": "", "\tA\u00a0B\n": "a_b"}
    assert {n: snake_case(n) for n in names} == names


def test_duplicates_and_uniques_on_digests(spark):
    from convlytics.operators.profile import distinct_counts, duplicate_rows

    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("a,", 1, "1"), ("a", 11, None), (None, None, None)],
                               "x string, y int, z string")
    r = duplicate_rows(df).first()
    assert (r.n_rows, r.n_duplicates) == (5, 1)
    assert {c.column: c.unique_values for c in distinct_counts(df).collect()} == {"x": 2, "y": 2, "z": 1}
    assert {c.column: c.unique_values for c in distinct_counts(df, null_as_value=True).collect()} == {"x": 3, "y": 3, "z": 2}
