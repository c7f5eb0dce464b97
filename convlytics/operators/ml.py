"""Escalation classifier: dataset preparation, split, training, scoring.

Training uses ``pyspark.ml`` logistic regression (distributed
``treeAggregate`` per iteration).  The class-balanced objective of the
reference is reproduced with instance weights ``n / (2 * n_class)``,
``regParam = 1 / n`` and no standardisation.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.errors import DataValidationError, ModelTrainingError
from convlytics.functions.labels import coerce_label
from convlytics.functions.text import MAX_CHARS, prepare_training_text

# Split fraction and seed, iteration cap, error costs.
TEST_FRACTION = 0.2
SPLIT_SEED = 42
MAX_ITER = 1000
FN_COST = 5
FP_COST = 1


def prepare_dataset(df: DataFrame, text_col: str = "full_conversation", label_col: str = "escalate_conversation",
                    max_chars: int | None = MAX_CHARS) -> DataFrame:
    """Adds ``text`` (NULL -> '', strip, first ``max_chars``; None keeps whole texts) and ``target`` (0/1); drops empty texts."""
    missing = {text_col, label_col} - set(df.columns)
    if missing:
        raise DataValidationError(f"missing columns: {sorted(missing)}")
    out = df.withColumn("text", prepare_training_text(text_col, max_chars)).filter(F.char_length("text") > 0)
    return out.withColumn("target", coerce_label(label_col))


def split_fraction_expr(id_col: str, seed: int = SPLIT_SEED):
    """Deterministic uniform value in [0, 1) from the row id and the seed."""
    h = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def stratified_split(df: DataFrame, id_col: str, label_col: str = "target", test_fraction: float = TEST_FRACTION,
                     seed: int = SPLIT_SEED, exact: bool = True) -> DataFrame:
    """Adds ``is_test``: each class has ``test_fraction`` of its rows in the test split.

    Rows are ranked by the hash of (id, seed); per class, the threshold is the
    ``test_fraction`` quantile of the hashes (a distributed exact quantile), so
    each class gets its share up to one row and hash ties.  ``exact=False``
    takes one threshold for all classes: no shuffle, but the classes keep
    their share in expectation only, and a small one may miss the test split.
    """
    u = split_fraction_expr(id_col, seed)
    out = df.withColumn("_u", u)
    if not exact:
        return out.withColumn("is_test", F.col("_u") < F.lit(test_fraction)).drop("_u")
    from convlytics.operators.ranking import running_sums

    counts = out.groupBy(F.col(label_col).alias("_c"), F.col("_u")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(counts, "_u", ["_n"], by=["_c"])
    totals = counts.groupBy("_c").agg(F.sum("_n").alias("_total"))
    # first hash value whose running count reaches round(fraction * class size)
    want = F.round(F.col("_total") * F.lit(test_fraction))
    thr = (cum.join(F.broadcast(totals), "_c").filter(F.col("cum__n") > want)
           .groupBy("_c").agg(F.min("_u").alias("_thr")))  # one row per class
    out = out.join(F.broadcast(thr), out[label_col] == thr["_c"], "left")
    return out.withColumn("is_test", F.coalesce(F.col("_u") < F.col("_thr"), F.lit(True))).drop("_u", "_c", "_thr")


#: classes a label may have: their counts are read by the driver
MAX_CLASSES = 1000


def _class_counts(df: DataFrame, label_col: str) -> dict:
    rows = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ModelTrainingError(f"{label_col} has more than {MAX_CLASSES} classes")
    return {r[label_col]: r["n"] for r in rows}


def _weight(counts: dict, label_col: str):
    n, k = sum(counts.values()), len(counts)
    pairs = [F.lit(x) for c, m in counts.items() for x in (c, n / (k * m))]
    return F.element_at(F.create_map(*pairs), F.col(label_col))


def class_weights(df: DataFrame, label_col: str = "target") -> DataFrame:
    """Adds ``weight`` = n / (2 * n_class) (balanced class weights)."""
    counts = _class_counts(df, label_col)
    return df.withColumn("weight", _weight(counts, label_col)) if counts else df.withColumn("weight", F.lit(None).cast("double"))


def train_model(train: DataFrame, features_col: str = "embedding", label_col: str = "target",
                max_iter: int = MAX_ITER) -> LogisticRegressionModel:
    """Balanced L2 logistic regression on array<float> features.

    One aggregate gives the row count, the classes and their weights; the fit
    reads ``train`` again, so pass a written table (as :func:`train_escalation`
    does) rather than a long lineage.
    """
    counts = _class_counts(train, label_col)
    if len(counts) < 2:
        raise ModelTrainingError("target has a single class")
    data = train.select(array_to_vector(features_col).alias("features"), F.col(label_col).cast("double").alias("label"),
                        _weight(counts, label_col).alias("weight"))
    lr = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter,
        regParam=1.0 / sum(counts.values()), elasticNetParam=0.0, standardization=False, fitIntercept=True, tol=1e-6,
    )
    return lr.fit(data)


def score(model: LogisticRegressionModel, df: DataFrame, features_col: str = "embedding") -> DataFrame:
    """Adds ``prediction`` (0/1) and ``score`` (probability of class 1)."""
    scored = model.transform(df.withColumn("features", array_to_vector(features_col)))
    return scored.withColumn("score", vector_to_array("probability")[1]).withColumn(
        "prediction", F.col("prediction").cast("int")
    ).drop("features", "rawPrediction", "probability")


def train_escalation(master: DataFrame, embed_fn, model_name: str, cache_path: str, work_path: str,
                     id_col: str = "thread_id", max_chars: int | None = MAX_CHARS):
    """Training text -> cached embeddings -> stratified split -> fit -> scored test rows.

    Texts, split features and scored test rows are each written once below
    ``work_path`` and read from there, so no model call and no join runs
    twice.  Returns (model, scored test rows).
    """
    from convlytics.operators.embed import embed_documents

    spark, base = master.sparkSession, work_path.rstrip("/")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    data = written(prepare_dataset(master, max_chars=max_chars).select(id_col, "text", "target"), "text")
    pooled = embed_documents(spark, data, id_col, "text", cache_path, embed_fn, model_name)
    rows = written(data.select(id_col, "target").join(pooled, id_col), "features")
    split = written(stratified_split(rows, id_col), "split")
    model = train_model(split.filter(~F.col("is_test")))
    scored = written(score(model, split.filter(F.col("is_test"))).select(id_col, "target", "prediction", "score"), "scored")
    return model, scored
