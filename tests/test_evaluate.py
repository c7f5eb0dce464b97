"""Evaluation metrics against brute-force definitions, with score ties."""

import itertools

import numpy as np
import pytest

from convlytics.operators.evaluate import (average_precision, classification_report, confusion_matrix,
                                           expected_cost, roc_auc)


def _data(spark, y, s):
    p = [int(v > 0.5) for v in s]
    return spark.createDataFrame([(int(a), float(b), c) for a, b, c in zip(y, s, p)],
                                 "target int, score double, prediction int")


def _brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def _brute_ap(y, s):
    y, s = np.asarray(y), np.asarray(s)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp = (y[sel] == 1).sum()
        prec, rec = tp / sel.sum(), tp / (y == 1).sum()
        ap += (rec - prev_r) * prec
        prev_r = rec
    return ap


def test_auc_and_ap_with_ties(spark):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 15, 300) / 15.0
    y = (rng.random(300) < 0.2 + 0.6 * s).astype(int)
    df = _data(spark, y, s)
    assert roc_auc(df).first().roc_auc == pytest.approx(_brute_auc(y, s), abs=1e-12)
    assert average_precision(df).first().pr_auc == pytest.approx(_brute_ap(y, s), abs=1e-12)


def test_confusion_report_cost(spark):
    y = [0, 0, 1, 1, 1]
    s = [0.9, 0.1, 0.2, 0.8, 0.7]
    df = _data(spark, y, s)
    cm = {(r.label, r.prediction): r.n for r in confusion_matrix(df).collect()}
    assert cm == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    rep = {r["class"]: r for r in classification_report(df).collect()}
    assert rep["1"].precision == pytest.approx(2 / 3) and rep["1"].recall == pytest.approx(2 / 3)
    assert rep["0"].support == 2 and rep["accuracy"].f1_score == pytest.approx(0.6)
    assert expected_cost(df).first().cost == 5 * 1 + 1 * 1


def test_zero_division_is_zero(spark):
    df = _data(spark, [0, 0, 1], [0.1, 0.2, 0.3])
    rep = {r["class"]: r for r in classification_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].f1_score == 0.0
