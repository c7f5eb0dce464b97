"""Text expressions against plain-Python rules (hypothesis + hand cases)."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convlytics.functions.text import chunk_words, extract_json_block, normalize_content, sha256_hex, ustrip, words

WS_CHARS = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​"]
text_st = st.lists(st.sampled_from(["a", "é", "b", "x1", "ñ"] + WS_CHARS), max_size=40).map("".join)


def _py_chunks(t, n):
    w = t.split()
    return [" ".join(w[i:i + n]) for i in range(0, len(w), n)]


@settings(max_examples=25, deadline=None)
@given(st.lists(text_st, min_size=1, max_size=20))
def test_strip_split_chunk_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = df.select("id", ustrip("t").alias("s"), words("t").alias("w"), chunk_words("t", 3).alias("c")).collect()
    for r in rows:
        t = texts[r.id]
        assert r.s == t.strip()
        assert list(r.w) == t.split()
        assert list(r.c) == _py_chunks(t, 3)


def test_unicode_whitespace_set(spark):
    # NBSP, NEL, U+001C and tab split; zero-width space does not
    t = "a\xa0b\x85c\x1cd\te​f"
    got = spark.createDataFrame([(t,)], "t string").select(words("t").alias("w")).first().w
    assert list(got) == t.split() == ["a", "b", "c", "d", "e​f"]


def test_sha256_matches_hashlib(spark):
    vals = ["", "abc", "é ñ 漢字"]
    got = spark.createDataFrame([(v,) for v in vals], "t string").select(sha256_hex("t").alias("h")).collect()
    assert [r.h for r in got] == [hashlib.sha256(v.encode()).hexdigest() for v in vals]


def test_extract_json_greedy_and_multiline(spark):
    vals = ['pre {"a": 1} mid {"b": 2} post', 'x\n{"a":\n1}\ny', "no braces", None]
    got = spark.createDataFrame([(v,) for v in vals], "t string").select(extract_json_block("t").alias("j")).collect()
    assert [r.j for r in got] == ['{"a": 1} mid {"b": 2}', '{"a":\n1}', None, None]


def test_normalize_variant_content(spark):
    vals = ['["a",1,true]', '{"k":"é"}', "null", '"  padded\\t"', "13.0", "7"]
    df = spark.createDataFrame([(v,) for v in vals], "j string").select(F.parse_json("j").alias("v"))
    got = [r.c for r in df.select(normalize_content("v", "variant").alias("c")).collect()]
    assert got == ["a; 1; true", '{"k":"é"}', "", "padded", "13.0", "7"]


def test_normalize_sql_null_and_plain_strings(spark):
    df = spark.createDataFrame([(None,), ("  x  ",)], "c string")
    assert [r.c for r in df.select(normalize_content("c", "string").alias("c")).collect()] == ["", "x"]


def test_python_spelling_of_numbers(spark):
    from convlytics.functions.text import python_float

    vals = [0.0, 13.0, -2.5, 12345678.9, 0.0001, 0.00012, 1e20, 1.5e-7, -1e16, 9999999.0, 1e7, 123456789012345.0, 1e15, 1.25e16,
            1e-3, 9.5e-5, 1e100, -3e-300, float("nan"), float("inf"), -float("inf"), 100.0, 1e22]
    got = spark.createDataFrame([(v,) for v in vals], "v double").select(python_float("v").alias("t")).collect()
    assert [r.t for r in got] == [repr(v) for v in vals]
    rows = spark.createDataFrame([([1e20, 2.0],), (None,)], "c array<double>").select(normalize_content("c", "array<double>").alias("t"))
    assert [r.t for r in rows.collect()] == ["1e+20; 2.0", ""]
    nan = spark.createDataFrame([(float("nan"),), (None,), (1e-5,)], "c double").select(normalize_content("c", "double").alias("t"))
    assert [r.t for r in nan.collect()] == ["", "", "1e-05"]
