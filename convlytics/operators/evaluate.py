"""Binary classifier evaluation on a scored frame (label, score, prediction).

Confusion matrix and report are conditional sums (one pass).  ROC-AUC and
average precision are exact: scores are first aggregated to one row per
distinct score (so ties are handled as groups and a hot score is one row),
then running class counts in score order come from
:func:`convlytics.operators.ranking.running_sums` -- no single-partition
window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.operators.ml import FN_COST, FP_COST
from convlytics.operators.ranking import attach_one_row, combine_one_row, running_sums


def _lp(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    return df.select(F.col(label_col).cast("int").alias("y"), F.col(pred_col).cast("int").alias("p"))


def confusion_matrix(df: DataFrame, label_col: str = "target", pred_col: str = "prediction") -> DataFrame:
    """(label, prediction, n) for all four cells of the 2x2 grid."""
    counts = _lp(df, label_col, pred_col).agg(
        *[F.sum(((F.col("y") == a) & (F.col("p") == b)).cast("long")).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]
    )
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"),
                               F.coalesce(F.col(f"c{a}{b}"), F.lit(0)).alias("n")) for a in (0, 1) for b in (0, 1)])
    return counts.select(F.explode(cells).alias("_c")).select("_c.label", "_c.prediction", "_c.n")


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, label_col: str = "target", pred_col: str = "prediction") -> DataFrame:
    """Rows per class '0', '1', then 'accuracy', 'macro avg', 'weighted avg'.

    Columns: class, precision, recall, f1_score, support.  Zero division
    gives 0.  The accuracy row carries accuracy in every metric column.
    """
    s = _lp(df, label_col, pred_col).agg(
        *[F.sum(((F.col("y") == a) & (F.col("p") == b)).cast("long")).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]
    ).select(*[F.coalesce(F.col(f"c{a}{b}"), F.lit(0)).cast("double").alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    rows = []
    for cls, other in ((0, 1), (1, 0)):
        tp, fp, fn = F.col(f"c{cls}{cls}"), F.col(f"c{other}{cls}"), F.col(f"c{cls}{other}")
        prec, rec = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
        rows.append((str(cls), prec, rec, _safe_div(2 * prec * rec, prec + rec), tp + fn))
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    acc = _safe_div(F.col("c00") + F.col("c11"), n)
    rows.append(("accuracy", acc, acc, acc, n))
    rows.append(("macro avg", (rows[0][1] + rows[1][1]) / 2, (rows[0][2] + rows[1][2]) / 2,
                 (rows[0][3] + rows[1][3]) / 2, n))
    rows.append(("weighted avg",
                 _safe_div(rows[0][1] * rows[0][4] + rows[1][1] * rows[1][4], n),
                 _safe_div(rows[0][2] * rows[0][4] + rows[1][2] * rows[1][4], n),
                 _safe_div(rows[0][3] * rows[0][4] + rows[1][3] * rows[1][4], n), n))
    arr = F.array(*[F.struct(F.lit(c).alias("class"), p.alias("precision"), r.alias("recall"),
                             f.alias("f1_score"), sup.cast("long").alias("support")) for c, p, r, f, sup in rows])
    return s.select(F.explode(arr).alias("_r")).select("_r.*")


def _score_counts(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    y = F.col(label_col).cast("int")
    return df.groupBy(F.col(score_col).cast("double").alias("s")).agg(
        F.sum(y.cast("long")).alias("pos"), F.sum((1 - y).cast("long")).alias("neg")
    )


def roc_auc(df: DataFrame, label_col: str = "target", score_col: str = "score") -> DataFrame:
    """One row ``roc_auc``: exact area, ties counted half (mid-rank statistic)."""
    counts = _score_counts(df, label_col, score_col)
    cum = running_sums(counts, "s", ["neg"])  # negatives at or below each score
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    part = cum.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * 0.5)).alias("_u"))
    out = attach_one_row(part, totals)
    return out.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_u") / (F.col("P") * F.col("N")))
                      .alias("roc_auc"))


def average_precision(df: DataFrame, label_col: str = "target", score_col: str = "score") -> DataFrame:
    """One row ``pr_auc``: step-wise average precision, sum of dRecall * precision."""
    counts = _score_counts(df, label_col, score_col)
    cum = running_sums(counts, "s", ["pos", "neg"], descending=True)
    totals = counts.agg(F.sum("pos").alias("P"))
    part = cum.agg(F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("_ap"))
    out = attach_one_row(part, totals)
    return out.select(F.when(F.col("P") > 0, F.col("_ap") / F.col("P")).alias("pr_auc"))


def expected_cost(df: DataFrame, label_col: str = "target", pred_col: str = "prediction",
                  fn_cost: float = FN_COST, fp_cost: float = FP_COST) -> DataFrame:
    """One row ``cost`` = fn_cost * FN + fp_cost * FP."""
    lp = _lp(df, label_col, pred_col)
    fn = F.sum(((F.col("y") == 1) & (F.col("p") == 0)).cast("long"))
    fp = F.sum(((F.col("y") == 0) & (F.col("p") == 1)).cast("long"))
    return lp.agg((F.coalesce(fn, F.lit(0)) * F.lit(fn_cost) + F.coalesce(fp, F.lit(0)) * F.lit(fp_cost)).alias("cost"))


def evaluate(df: DataFrame, label_col: str = "target", score_col: str = "score",
             pred_col: str = "prediction") -> DataFrame:
    """One row: roc_auc, pr_auc, cost."""
    return combine_one_row([
        roc_auc(df, label_col, score_col),
        average_precision(df, label_col, score_col),
        expected_cost(df, label_col, pred_col),
    ])
