"""Answer scoring, lenient JSON, routes, prompts, transcripts."""

import json

from pyspark.sql import functions as F

from convlytics.functions.jsonudf import is_strict_json, parse_json_lenient
from convlytics.operators.answers import (EXPECTED_KEYS, normalize_route, score_answers, session_transcript,
                                          system_prompts)


def test_strict_and_lenient_json(spark):
    vals = ['{"a":1} tail', '{"a":1,"a":2}', '{"a":NaN}', "{'a':1}", "[1]", ""]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    rows = df.select(is_strict_json(F.col("t")).alias("ok"), parse_json_lenient(F.col("t")).alias("p")).collect()
    assert [r.ok for r in rows] == [False, True, True, False, True, False]
    assert rows[0].p == '{"a":1}' and rows[3].p == "{}" and rows[4].p == "[1]"


def test_answer_scoring(spark):
    full = json.dumps({"summary": "s", "insights": ["i"], "risks": [], "actions": [], "metrics_used": []})
    vals = [full, 'ok: {"summary": "x"} bye', "[1]", "nope {", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, answer string")
    got = {r.id: r for r in score_answers(df).collect()}
    assert got[0].json_valido and got[0].score_estructura == 1.0 and got[0].insights_no_vacios
    assert not got[0].actions_no_vacios
    assert got[1].claves_presentes == ["summary"] and got[1].score_estructura == 0.2
    assert got[2].json_valido and got[2].score_estructura == 0.0 and got[2].claves_faltantes == sorted(EXPECTED_KEYS)
    assert not got[3].json_valido and got[3].claves_faltantes == sorted(EXPECTED_KEYS)
    assert not got[4].json_valido


def test_route_normalisation(spark):
    df = spark.createDataFrame([("escalar",), ("Escalar",), (None,), ("resumen",)], "r string")
    assert [r.x for r in df.select(normalize_route("r").alias("x")).collect()] == [
        "escalar", "assistant", "assistant", "resumen"]


def test_system_prompt_with_context(spark):
    master = spark.createDataFrame([(1, 2.0, 3)], "escalate_conversation int, duration_minutes double, msg_count long")
    qs = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    ctx = spark.createDataFrame([("q1", "- hit")], "query_id string, context string")
    got = {r.question_id: r.system_prompt for r in system_prompts(qs, master, ctx).collect()}
    assert got["q2"].endswith("Contexto:\nTasa de escalamiento: 1.000\nDuracion promedio (min): 2.00\n"
                              "Mensajes promedio: 3.00")
    assert got["q1"].endswith("\n\nContexto semantico relevante:\n- hit")
    assert '{\n  "summary"' in got["q1"]


def test_session_transcript_replaces_equal_ids(spark):
    m = spark.createDataFrame([("s", 1, 1, "user", "hola"), ("s", 2, 2, "assistant", "v1"),
                               ("s", 2, 3, "assistant", "v2")],
                              "session_id string, message_id int, seq int, role string, text string")
    r = session_transcript(m).first()
    assert r.transcript == "user: hola\nassistant: v2" and r.n_messages == 2


def test_session_transcript_hot_split_matches(spark):
    rows = [("hot", i, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3000)]
    rows += [("cold", 1, 1, "user", "x")]
    m = spark.createDataFrame(rows, "session_id string, message_id int, seq int, role string, text string")
    single = {r.session_id: (r.transcript, r.n_messages) for r in session_transcript(m, hot_rows=0).collect()}
    split = {r.session_id: (r.transcript, r.n_messages) for r in session_transcript(m, hot_rows=100).collect()}
    assert single == split and single["hot"][1] == 3000


def test_raw_lookup_hot_split_matches(spark):
    from convlytics.operators.metrics import conversation_text_raw

    rows = [("h", i, f"w{i % 7}") for i in range(2500)] + [("h", None, "tail"), ("h", None, None), ("c", 1, "x")]
    m = spark.createDataFrame(rows, "thread_id string, seq int, content string")
    ids = spark.createDataFrame([("h",), ("c",)], "thread_id string")
    single = {r.thread_id: r.conversation for r in conversation_text_raw(m, ids, "seq", hot_rows=0).collect()}
    split = {r.thread_id: r.conversation for r in conversation_text_raw(m, ids, "seq", hot_rows=50).collect()}
    assert single == split and single["h"].endswith("\nNone\ntail")


def test_call_model_keeps_odd_column_names(spark):
    from convlytics.operators.answers import call_model

    df = spark.createDataFrame([("s", "u", 1)], "`sys prompt` string, `user-text` string, n int")
    out = call_model(df, lambda s, u: s + u, "sys prompt", "user-text", "reply", timed=True).first()
    assert out.reply == "su" and out.n == 1 and out.elapsed_s >= 0


def _dead_model(system, user):
    raise RuntimeError("no model")


def test_a_failing_model_raises_unless_captured(spark):
    import pytest

    from convlytics.operators.answers import call_model

    df = spark.createDataFrame([("s", "u")], "s string, u string")
    with pytest.raises(Exception, match="no model"):
        call_model(df, _dead_model, "s", "u").collect()
    assert call_model(df, _dead_model, "s", "u", on_error="capture").first().response == "no model"
    with pytest.raises(ValueError):
        call_model(df, _dead_model, "s", "u", on_error="ignore")


def test_hostile_answers_do_not_end_a_batch(spark):
    from pyspark.sql import functions as F

    from convlytics.functions.jsonudf import is_strict_json, parse_json_lenient
    from convlytics.operators.answers import score_answers

    rows = ['"\\ud800"', '{"\\udfff": ["\\ud800"]}', "[" * 100_000, '{"a":' * 5_000, '{"a": 1, "a": 2}', "NaN", None,
            'x {"insights": [1], "actions": []} y', "", "1" * 5_000]
    df = spark.createDataFrame([(r,) for r in rows], "answer string")
    lenient = [r.a for r in df.select(parse_json_lenient(F.col("answer")).alias("a")).collect()]
    assert lenient == ['"\\ud800"', '{"\\udfff":["\\ud800"]}', "{}", "{}", '{"a":2}', "NaN", "{}", '{"insights":[1],"actions":[]}',
                       "{}", "{}"]
    strict = [r.s for r in df.select(is_strict_json(F.col("answer")).alias("s")).collect()]
    assert strict == [True, True, False, False, True, True, False, False, False, False]
    scored = score_answers(df).collect()
    assert [r.json_valido for r in scored] == [True, True, False, False, True, True, False, True, False, False]
    assert scored[7].insights_no_vacios and not scored[7].actions_no_vacios
