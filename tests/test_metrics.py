"""Metrics, buckets, label coercion and the distributed ranking helpers."""

import numpy as np
import pytest
from pyspark.errors import ArithmeticException, NumberFormatException, SparkRuntimeException
from pyspark.sql import functions as F

from convlytics.functions.labels import coerce_label, volume_bucket
from convlytics.operators import metrics as MT
from convlytics.operators.ranking import exact_quantile, running_sums


def test_volume_bucket_edges(spark):
    vals = [0, 2, 3, 5, 6, 100, 101]
    df = spark.createDataFrame([(v,) for v in vals], "n int")
    got = [r.b for r in df.select(volume_bucket("n").alias("b")).collect()]
    assert got == ["0-2", "0-2", "3-5", "3-5", "6-10", "51-100", "100+"]


def test_label_coercion(spark):
    df = spark.createDataFrame([(True, 1.9, None)], "b boolean, d double, n int")
    r = df.select(coerce_label("b").alias("b"), coerce_label("d").alias("d"), coerce_label("n").alias("n")).first()
    assert (r.b, r.d, r.n) == (1, 1, 0)
    with pytest.raises((NumberFormatException, SparkRuntimeException, ArithmeticException, Exception)):
        spark.createDataFrame([("true",)], "s string").select(coerce_label("s")).collect()


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_exact_quantile_matches_numpy(spark, q):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.integers(0, 20, 300), rng.normal(size=200).round(2)]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = exact_quantile(df, "x", q, "p", n_buckets=7).first().p
    assert got == pytest.approx(float(np.quantile(vals, q)), rel=1e-12, abs=1e-12)


def test_running_sums_match_cumsum(spark):
    rng = np.random.default_rng(2)
    vals = rng.permutation(500).astype(float)
    w = rng.integers(0, 5, 500)
    df = spark.createDataFrame([(float(v), int(x)) for v, x in zip(vals, w)], "s double, w long")
    for desc in (False, True):
        got = {r.s: r.cum_w for r in running_sums(df, "s", ["w"], descending=desc, n_buckets=9).collect()}
        order = np.argsort(-vals if desc else vals)
        cum = np.cumsum(w[order])
        assert all(got[vals[i]] == c for i, c in zip(order, cum))


def _master(spark):
    return spark.createDataFrame(
        [("a", 1, 10.0, 3, "open"), ("b", None, 0.0, 1, "closed"), ("c", 0, 5.0, 2, "open"), ("d", 1, 1.0, 9, None)],
        "thread_id string, escalate_conversation int, duration_minutes double, msg_count long, status string",
    )


def test_impact_metrics_values(spark):
    r = MT.impact_metrics(_master(spark)).first()
    assert r.tasa_escalamiento == pytest.approx(0.5)
    assert r.duracion_p90_min == pytest.approx(float(np.quantile([10.0, 0.0, 5.0, 1.0], 0.9)))
    assert r.mensajes_p90 == pytest.approx(float(np.quantile([3, 1, 2, 9], 0.9)))
    assert r.estado_top == '{"open":2,"closed":1}'


def test_impact_metrics_skip_absent_columns(spark):
    r = MT.impact_metrics(_master(spark).select("thread_id", "msg_count"))
    assert r.columns == ["mensajes_promedio", "mensajes_p90"]


def test_escalation_by_category_drops_null_keys(spark):
    got = MT.escalation_by_category(_master(spark), "status").collect()
    assert [(r.status, r.escalation_rate) for r in got] == [("open", 0.5), ("closed", 0.0)]


def test_escalation_by_volume_emits_all_buckets(spark):
    got = MT.escalation_by_volume(_master(spark)).collect()
    assert [r.msg_bucket for r in got] == ["0-2", "3-5", "6-10", "11-20", "21-50", "51-100", "100+"]
    assert got[3].escalation_rate is None and got[3].n_threads == 0


def test_context_summary_format(spark):
    s = MT.context_summary(_master(spark)).first().summary
    assert s == "Tasa de escalamiento: 0.500\nDuracion promedio (min): 4.00\nMensajes promedio: 3.75"


def test_top_threads_ties_by_id(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "thread_id string, msg_count long")
    assert [r.thread_id for r in MT.top_threads_by_messages(df, 2).collect()] == ["a", "b"]


def test_monthly_trend(spark):
    df = spark.createDataFrame([("2024-01-05", 1), ("2024-01-20", 0), ("2024-02-01", None), (None, 1)],
                               "created_at string, escalate_conversation int")
    got = [(r.month, r.escalation_rate) for r in MT.monthly_trend(df).collect()]
    assert got == [("2024-01", 0.5), ("2024-02", 0.0)]


def test_metrics_json_round_trip(spark):
    import json

    j = MT.metrics_json(MT.impact_metrics(_master(spark))).first().metrics_json
    assert json.loads(j)["estado_top"] == '{"open":2,"closed":1}'


def test_duplicates_and_profiles(spark):
    from convlytics.operators.profile import duplicate_rows, profile_missing, profile_uniques

    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, 1.0)], "x int, y string, z double")
    d = duplicate_rows(df).first()
    assert (d.n_rows, d.n_duplicates) == (3, 1)
    miss = [(r.column, r.missing_count) for r in profile_missing(df).collect()]
    assert miss == [("z", 2), ("y", 1)]
    uniq = [(r.column, r.unique_values) for r in profile_uniques(df).collect()]
    assert uniq == [("x", 2), ("y", 1), ("z", 1)]
    uniq_none = dict((r.column, r.unique_values) for r in profile_uniques(df, null_as_value=True).collect())
    assert uniq_none["y"] == 2
    assert F is not None


def test_impact_metrics_strict_raises_on_empty(spark):
    from convlytics.errors import DataValidationError

    with pytest.raises(DataValidationError):
        MT.impact_metrics(_master(spark).limit(0), strict=True)
    with pytest.raises(DataValidationError):
        MT.impact_metrics(_master(spark).limit(0))
    assert MT.impact_metrics(_master(spark).limit(0), strict=False).first().tasa_escalamiento is None


def test_bucket_binary_search(spark):
    from convlytics.operators.ranking import bucket_of

    splits = [0.5, 1.0, 2.0, 7.0, 9.5]
    xs = [-1.0, 0.5, 0.6, 1.0, 3.0, 7.0, 9.4, 9.5, 100.0]
    df = spark.createDataFrame([(x, splits) for x in xs], "x double, s array<double>")
    got = [r.b for r in df.select(bucket_of(F.col("x"), F.col("s"), 7).alias("b")).collect()]
    assert got == [sum(1 for s in splits if s < x) for x in xs]


def test_running_sums_per_group(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(v), int(w)) for g in range(3) for v, w in zip(rng.permutation(200), rng.integers(0, 4, 200))]
    df = spark.createDataFrame(rows, "g int, s double, w long")
    got = {(r.g, r.s): r.cum_w for r in running_sums(df, "s", ["w"], by=["g"], n_buckets=5).collect()}
    for g in range(3):
        sub = sorted((s, w) for gg, s, w in rows if gg == g)
        total = 0
        for s, w in sub:
            total += w
            assert got[(g, s)] == total
