"""Embedding cache behaviour and classifier training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlytics.errors import EmbeddingError, ModelTrainingError
from convlytics.functions.embedders import HashingEmbedder
from convlytics.operators.embed import chunk_texts, embed_documents, fill_cache, mean_pool
from convlytics.operators.ml import stratified_split, train_model
from convlytics.session import scratch_path


def test_cache_reuse_and_model_key(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d e")], "id int, t string")
    chunks = chunk_texts(docs, "id", "t", chunk_size=2)
    path = scratch_path(spark, "test-cache")
    emb = HashingEmbedder(8)
    first = fill_cache(spark, chunks, path, emb, "m1").count()
    again = fill_cache(spark, chunks, path, emb, "m1").count()
    other = fill_cache(spark, chunks, path, emb, "m2").count()
    assert (first, again, other) == (3, 0, 3)  # 'a b', 'c', 'd e'


def test_mean_pool_counts_repeated_chunks(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 3.0])], "id int, embedding array<double>")
    got = mean_pool(df, "id").first().embedding
    assert np.allclose(got, [2 / 3, 1.0])


def test_embed_documents_end_to_end_and_empty(spark):
    docs = spark.createDataFrame([(1, "x y z"), (2, "")], "id int, t string")
    out = embed_documents(spark, docs, "id", "t", scratch_path(spark, "c"), HashingEmbedder(4), "h4").collect()
    assert [r.id for r in out] == [1] and len(out[0].embedding) == 4
    with pytest.raises(EmbeddingError):
        embed_documents(spark, docs.limit(0), "id", "t", scratch_path(spark, "c"), HashingEmbedder(4), "h4")


def test_single_class_raises(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([0.0, 1.0], 1)], "embedding array<double>, target int")
    with pytest.raises(ModelTrainingError):
        train_model(df)


def test_split_is_deterministic_and_near_fraction(spark):
    df = spark.range(4000).withColumn("target", (F.col("id") % 5 == 0).cast("int"))
    a = stratified_split(df, "id").groupBy("target").agg(F.avg(F.col("is_test").cast("double")).alias("f")).collect()
    assert all(abs(r.f - 0.2) < 0.03 for r in a)
    s1 = [r.is_test for r in stratified_split(df, "id").orderBy("id").limit(50).collect()]
    s2 = [r.is_test for r in stratified_split(df, "id").orderBy("id").limit(50).collect()]
    assert s1 == s2


def test_balanced_objective_gradient_is_small(spark):
    """At Spark's optimum the gradient of the class-balanced L2 objective (C=1) is ~0."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 4))
    y = (X[:, 0] + 0.5 * rng.normal(size=300) > 0.8).astype(int)
    df = spark.createDataFrame([(x.tolist(), int(t)) for x, t in zip(X, y)], "embedding array<double>, target int")
    m = train_model(df)
    w, b = m.coefficients.toArray(), m.intercept
    n, n1 = len(y), y.sum()
    sw = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    p = 1 / (1 + np.exp(-(X @ w + b)))
    grad_w = w + (sw * (p - y)) @ X
    grad_b = (sw * (p - y)).sum()
    assert np.abs(grad_w).max() < 1e-3 * n and abs(grad_b) < 1e-3 * n


def test_exact_split_takes_class_share(spark):
    df = spark.range(1000).withColumn("target", (F.col("id") % 10 == 0).cast("int"))
    got = {r.target: (r.n, r.t) for r in stratified_split(df, "id", exact=True).groupBy("target").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert got[1] == (100, 20) and got[0] == (900, 180)


def test_embed_rows_on_empty_and_filtered_input(spark):
    from convlytics.operators.embed import embed_rows

    df = spark.createDataFrame([("h1", "a b"), ("h2", "c")], "text_hash string, chunk string").repartition(4)
    out = embed_rows(df.filter(F.col("chunk") == "c"), HashingEmbedder(4), "h4").collect()
    assert [r.text_hash for r in out] == ["h2"] and len(out[0].embedding) == 4
    assert embed_rows(df.limit(0), HashingEmbedder(4), "h4").count() == 0


def test_calls_hold_texts_of_like_length_within_the_budget():
    from convlytics.functions.embedders import call_slices

    sizes = np.array([3, 100, 5, 4, 50, 2, 7, 1])
    got = [c.tolist() for c in call_slices(sizes, 3, 60)]
    assert got == [[1], [4], [6, 2, 3], [0, 5, 7]]
    assert [len(c) for c in call_slices(np.ones(10, int), 4, None)] == [4, 4, 2] and list(call_slices(np.ones(0, int), 4, 9)) == []
    for c in call_slices(np.random.default_rng(1).integers(1, 80, 500), 64, 200):
        assert len(c) == 1 or len(c) <= 64


def test_a_factory_is_opened_once_a_worker(spark, tmp_path):
    from convlytics.functions.embedders import ModelFactory
    from convlytics.operators.embed import embed_rows

    marks = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(marks, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        inner = HashingEmbedder(8)

        def embed(texts):
            words = [t.count(" ") + 1 for t in texts]
            assert len(texts) == 1 or max(words) * len(texts) <= 50
            return inner(texts)

        return embed

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(1, 70))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "text_hash string, chunk string").repartition(12)
    model = ModelFactory("counted-" + marks, load, max_tokens=50)
    for _ in range(2):
        got = {int(r.text_hash): r.embedding for r in embed_rows(df, model, "m").collect()}
        want = HashingEmbedder(8)(texts)
        assert all(np.allclose(got[i], want[i]) for i in range(400))
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(workers) == len(set(workers)) < 24  # 24 tasks, one opening in each process


def test_hashing_equals_token_by_token():
    import zlib

    texts = ["a b a", "", "c", None, "é ü 日本"]
    out = np.zeros((5, 16))
    for i, t in enumerate(texts):
        for tok in (t or "").split():
            h = zlib.crc32(tok.encode("utf-8"))
            out[i, h % 16] += 1.0 if (h >> 31) & 1 else -1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    assert np.allclose(HashingEmbedder(16)(texts), np.divide(out, n, out=np.zeros_like(out), where=n > 0))
