"""Master table edge cases (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from convlytics.errors import DataValidationError
from convlytics.operators.master import build_master, conversation_aggregate


def _msgs(spark, rows, schema="thread_id string, created_at string, content string"):
    return spark.createDataFrame(rows, schema)


def test_thread_id_keeps_leading_zeros(spark):
    t = spark.createDataFrame([("001", "x")], "thread_id string, status string")
    m = _msgs(spark, [("001", "2024-01-01T00:00:00Z", "hola")])
    r = build_master(t, m).first()
    assert r.thread_id == "001" and r.full_conversation == "hola"


def test_mixed_iso_shapes_parse_or_null(spark):
    rows = [("t", v, str(i)) for i, v in enumerate(
        ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123Z", "2024-01-02", "2024-01-01T10:00:00+0200", "x", None])]
    a = conversation_aggregate(_msgs(spark, rows), hot_thread_rows=None).first()
    assert a.msg_count == 6
    assert a.first_msg == dt.datetime(2024, 1, 1, 0, 0)
    assert a.last_msg == dt.datetime(2024, 1, 2, 0, 0)


def test_extended_and_canonical_dates(spark):
    df = spark.createDataFrame(
        [("t", '{"$date":"2024-01-01T00:00:00Z"}', '"a"'),
         ("t", '{"$date":{"$numberLong":"1700000000000"}}', '"b"')], "thread_id string, d string, c string"
    ).select("thread_id", F.parse_json("d").alias("created_at"), F.parse_json("c").alias("content"))
    a = conversation_aggregate(df, hot_thread_rows=None).first()
    assert a.first_msg == a.last_msg == dt.datetime(2024, 1, 1)
    # the canonical form does not parse: NULL sorts last
    assert a.full_conversation == "a | b"


def test_created_at_name_fallback(spark):
    m = spark.createDataFrame([("t", "2024-01-01T00:00:00Z", "a")], "thread_id string, createdAt string, content string")
    a = conversation_aggregate(m, hot_thread_rows=None).first()
    assert a.first_msg == dt.datetime(2024, 1, 1)


def test_no_date_column_gives_null_times_and_zero_duration(spark):
    t = spark.createDataFrame([("t",)], "thread_id string")
    m = spark.createDataFrame([("t", "a"), ("t", "b")], "thread_id string, content string")
    r = build_master(t, m).first()
    assert r.first_msg is None and r.duration_minutes == 0.0 and r.full_conversation == "a | b"


def test_null_timestamps_last_ties_by_content(spark):
    m = _msgs(spark, [("t", None, "n"), ("t", "2024-01-02", "late"), ("t", "2024-01-01", "z1"),
                      ("t", "2024-01-01", "a1")])
    a = conversation_aggregate(m, hot_thread_rows=None).first()
    assert a.full_conversation == "a1 | z1 | late | n"


def test_seq_breaks_ties(spark):
    m = spark.createDataFrame([("t", 2, "first?"), ("t", 1, "zz")], "thread_id string, seq int, content string")
    a = conversation_aggregate(m, seq_col="seq", hot_thread_rows=None).first()
    assert a.full_conversation == "zz | first?"


def test_blank_messages_counted_not_joined(spark):
    m = _msgs(spark, [("t", "2024-01-01", " "), ("t", "2024-01-02", None), ("t", "2024-01-03", "a"),
                      ("u", "2024-01-01", "")])
    got = {r.thread_id: r for r in conversation_aggregate(m, hot_thread_rows=None).collect()}
    assert got["t"].full_conversation == "a" and got["t"].msg_count == 3
    assert got["u"].full_conversation == "" and got["u"].msg_count == 1


def test_hot_thread_split_matches_single_level(spark):
    rows = [("hot", f"2024-01-{d:02d}T{h:02d}:00:00Z", f"m{d}-{h}-{i}") for d in range(1, 4) for h in range(5)
            for i in range(3)] + [("hot", None, "nulltail"), ("hot", None, "anull"), ("cold", "2024-01-01", "c")]
    m = _msgs(spark, rows)
    single = {r.thread_id: tuple(r) for r in conversation_aggregate(m, hot_thread_rows=None).collect()}
    split = {r.thread_id: tuple(r) for r in conversation_aggregate(m, hot_thread_rows=5).collect()}
    assert single == split


def test_name_clash_and_reserved_names(spark):
    m = _msgs(spark, [("t", "2024-01-01", "a")])
    clash = spark.createDataFrame([("t", "x", "y")], "thread_id string, `Created At` string, created_at string")
    with pytest.raises(DataValidationError):
        build_master(clash, m)
    reserved = spark.createDataFrame([("t", 1)], "thread_id string, msg_count int")
    with pytest.raises(DataValidationError):
        build_master(reserved, m)


def test_missing_required_columns(spark):
    t = spark.createDataFrame([("t",)], "thread_id string")
    with pytest.raises(DataValidationError):
        build_master(t, spark.createDataFrame([("t",)], "thread_id string"))


def test_threads_without_messages_are_dropped(spark):
    t = spark.createDataFrame([("a",), ("b",), ("a",)], "thread_id string")
    m = _msgs(spark, [("a", "2024-01-01", "x")])
    assert sorted(r.thread_id for r in build_master(t, m).collect()) == ["a", "a"]


def test_hot_thread_detection_flags_only_big_threads(spark):
    from convlytics.operators.master import clean_messages, hot_threads

    rows = [("hot", "2024-01-01", f"m{i}") for i in range(40)] + [("cold", "2024-01-01", "c")]
    hot = [r.thread_id for r in hot_threads(clean_messages(_msgs(spark, rows)), 5).collect()]
    assert hot == ["hot"]


def test_question_validation_and_stable_session_ids(spark):
    from convlytics.operators.schema import validate_questions

    df = spark.createDataFrame([("1", "hola", None), ("2", "", "s"), ("3", "x" * 2001, "s" * 129)],
                               "qid string, question string, session_id string")
    a = {r.qid: r for r in validate_questions(df, id_col="qid").collect()}
    b = {r.qid: r for r in validate_questions(df, id_col="qid").collect()}
    assert a["1"].valid and not a["2"].question_ok and not a["3"].session_ok
    assert a["1"].session_id_final == b["1"].session_id_final and len(a["1"].session_id_final) == 36
    assert a["2"].session_id_final == "s"


def test_empty_inputs_raise_unless_told_otherwise(spark):
    from convlytics.operators.metrics import impact_metrics

    t = spark.createDataFrame([("a", 1)], "thread_id string, escalate_conversation int")
    m = _msgs(spark, [("b", "2024-01-01", "x")])
    with pytest.raises(DataValidationError):
        build_master(t, m.limit(0))  # nothing to aggregate
    with pytest.raises(DataValidationError):
        build_master(t, m)  # no thread has a message
    assert build_master(t, m, strict=False).count() == 0
    with pytest.raises(DataValidationError):
        impact_metrics(build_master(t, m, strict=False))
    assert impact_metrics(build_master(t, m, strict=False), strict=False).first()["tasa_escalamiento"] is None


def test_text_seq_and_bursts_on_hot_threads(spark):
    rows = [("hot", None, f"s{i:03d}", f"m{i}") for i in range(50)] + [("hot", "2024-01-01", "x", "same")] * 30
    m = spark.createDataFrame(rows, "thread_id string, created_at string, seq string, content string")
    one = conversation_aggregate(m, seq_col="seq", hot_thread_rows=None).collect()
    assert [tuple(r) for r in conversation_aggregate(m, seq_col="seq", hot_thread_rows=5).collect()] == [tuple(r) for r in one]


def test_requested_threads_only(spark):
    m = _msgs(spark, [("a", "2024-01-01", "x"), ("b", "2024-01-01", "y")])
    t = spark.createDataFrame([("a",), ("b",)], "thread_id string")
    got = build_master(t, m, thread_ids=spark.createDataFrame([("b",), ("b",), (None,)], "thread_id string")).collect()
    assert [(r.thread_id, r.full_conversation) for r in got] == [("b", "y")]


def test_messages_of_variants_are_not_broadcast(spark, tmp_path):
    """Spark expects 2 kB of a VARIANT, and so nearly nothing of a table without its VARIANT columns."""
    from pyspark.sql import functions as F

    from convlytics.operators.master import build_master, dropped_thread_count, threads_without_messages

    path = str(tmp_path / "messages")
    m = spark.range(4000).select((F.col("id") % 500).cast("string").alias("thread_id"), F.parse_json(F.lit('"text"')).alias("content"))
    m.write.parquet(path)
    m, t = spark.read.parquet(path), spark.range(500).select(F.col("id").cast("string").alias("thread_id"))
    for df in (build_master(t, m), threads_without_messages(t, m), dropped_thread_count(t, m)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and ("Inner" in x or "LeftOuter" in x)]
    assert build_master(t, m).count() == 500
