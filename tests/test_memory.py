"""Exact top-k search against NumPy brute force, forced into many blocks."""

import numpy as np

from convlytics.operators.memory import knn_topk, memory_items, semantic_context


def _brute(q, c, k, digits=None):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    s = unit(q) @ unit(c).T
    if digits:  # equal directions tie, however sums are rounded
        s = np.round(s, digits)
    out = {}
    for i in range(len(q)):
        order = sorted(range(len(c)), key=lambda j: (-s[i, j], str(j)))[:k]
        out[str(i)] = [(str(j), s[i, j]) for j in order]
    return out


def test_knn_matches_brute_force_across_blocks(spark):
    rng = np.random.default_rng(4)
    q = rng.normal(size=(37, 8))
    c = rng.integers(-2, 3, size=(53, 8)).astype(float)  # many exact ties
    c[5] = 0.0  # zero vector scores 0
    qdf = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(q)], "query_id string, embedding array<double>")
    cdf = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(c)], "item_id string, embedding array<double>")
    got = {}
    for r in knn_topk(qdf, cdf, k=4, block_bytes=8 * 8 * 7, pairs_per_task=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.item_id, r.score))
    want = _brute(q, c, 4)
    for qid, hits in want.items():
        hits_got = sorted(got[qid])
        assert [h[1] for h in hits_got] == [h[0] for h in hits]
        assert np.allclose([h[2] for h in hits_got], [h[1] for h in hits])


def _frame(spark, name, m):
    return spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(m)], f"{name} string, embedding array<double>")


def test_pruned_search_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(14)
    q = np.vstack([rng.normal(size=(20, 5)), rng.integers(-1, 2, size=(20, 5))])
    c = np.vstack([rng.integers(-2, 3, size=(150, 5)), rng.normal(size=(100, 5)) * 3, np.tile([1.0, 2, 0, 0, 1], (120, 1))]).astype(float)
    want = _brute(q, c, 6, digits=12)
    for cells, opts in ((1, {}), (9, {"pairs_per_task": 400}), (200, {"block_bytes": 5 * 8 * 11, "pairs_per_task": 200})):
        got = {}
        for r in knn_topk(_frame(spark, "query_id", q), _frame(spark, "item_id", c), k=6, cells=cells, **opts).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.item_id, r.score))
        assert {i: [h[1] for h in sorted(hits)] for i, hits in got.items()} == {i: [h[0] for h in hits] for i, hits in want.items()}


def test_pruned_inner_products_of_any_length(spark):
    rng = np.random.default_rng(15)
    q, c = rng.normal(size=(30, 4)), rng.normal(size=(200, 4)) * rng.choice([0.0, 0.1, 5.0], size=(200, 1))
    whole = knn_topk(_frame(spark, "query_id", q), _frame(spark, "item_id", c), k=5, normalize=False, cells=0)
    pruned = knn_topk(_frame(spark, "query_id", q), _frame(spark, "item_id", c), k=5, normalize=False, cells=25, pairs_per_task=500)
    assert sorted(tuple(r)[:3] for r in pruned.collect()) == sorted(tuple(r)[:3] for r in whole.collect())


def test_clustered_vectors_score_few_pairs(spark):
    """Share of the pairs that are scored: 64 clusters, 4000 items, 300 queries."""
    from pyspark.sql import functions as F

    import convlytics.operators.memory as M

    rng = np.random.default_rng(16)
    centres = rng.normal(size=(64, 16))
    make = lambda n: centres[np.arange(n) % 64] + rng.normal(size=(n, 16)) * 0.05
    c, q = make(4000), make(300)
    items = _frame(spark, "id", c / np.linalg.norm(c, axis=1, keepdims=True)).withColumnRenamed("embedding", "v")
    asked = _frame(spark, "id", q / np.linalg.norm(q, axis=1, keepdims=True)).withColumnRenamed("embedding", "v")
    plan, placed = M.corpus_cells(items, 4000, 16, 256, 100)
    kth = (M._visited(M.visits(asked.withColumn("reached", F.lit(None).cast("double")), plan, 4, 1), placed, 4)
           .where("rank = 4").selectExpr("query_id id", "score reached"))
    went = M.visits(asked.join(kth, "id"), plan, 4, 1)
    share = went.select("id", "pairs").distinct().agg(F.sum("pairs")).first()[0] / (4000 * 300)
    assert 0 < share < 0.1, share
    # every vector lies in one block, and none outside its cell's bound
    assert placed.count() == 4000 and placed.select("block").distinct().count() <= plan.blocks
    score = q / np.linalg.norm(q, axis=1, keepdims=True) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    assert (plan.bounds(q / np.linalg.norm(q, axis=1, keepdims=True)).max(1) >= score.max(1) - 1e-9).all()


def test_k_capped_by_corpus_and_empty_corpus(spark):
    qdf = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    cdf = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item_id string, embedding array<double>")
    assert knn_topk(qdf, cdf, k=5).count() == 2
    assert knn_topk(qdf, cdf.limit(0), k=5).count() == 0


def test_context_and_memory_text(spark):
    qa = spark.createDataFrame([("1", "q1", "a1", "t"), ("2", "q2", "", "t"), ("3", "q3", None, "t")],
                               "id string, q string, a string, t string")
    items = memory_items(qa, "q", "a", "id", "t", "t").collect()
    assert [(r.item_id, r.text) for r in items] == [("1", "Pregunta: q1\nRespuesta: a1")]
    hits = spark.createDataFrame([("q", 2, "x"), ("q", 1, "y")], "query_id string, rank int, item_id string")
    corpus = spark.createDataFrame([("x", "tx"), ("y", "ty")], "item_id string, text string")
    assert semantic_context(hits, corpus).first().context == "- ty\n- tx"


def test_tiles_and_blocks_give_one_answer(spark, monkeypatch):
    import convlytics.operators.memory as M

    rng = np.random.default_rng(6)
    q = rng.integers(-2, 3, size=(40, 6)).astype(float)
    c = rng.integers(-2, 3, size=(30, 6)).astype(float)
    qdf = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(q)], "query_id string, embedding array<double>")
    cdf = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(c)], "item_id string, embedding array<double>")
    a = sorted(tuple(r) for r in knn_topk(qdf, cdf, k=3).collect())
    b = sorted(tuple(r) for r in knn_topk(qdf, cdf, k=3, block_bytes=6 * 8 * 8).collect())
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b])
    order = np.arange(30)
    whole = M.block_topk(q, c, order, 4)
    tiled = M.block_topk(q, c, order, 4, tile=7)
    assert (whole[0] == tiled[0]).all() and np.allclose(whole[1], tiled[1])


def test_odd_vectors_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    schema = "{} string, embedding array<double>"
    corpus = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [nan, 1.0]), ("e", [1.0]), ("f", [inf, 0.0]),
              ("a", [0.0, 1.0]), ("g", [1.0, None])]
    queries = [("q", [1.0, 0.0]), ("q", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("m", [nan, 0.0])]
    for blocks in ({}, {"block_bytes": 16, "pairs_per_task": 1}, {"cells": 2}, {"block_bytes": 16, "cells": 0}):
        got = knn_topk(spark.createDataFrame(queries, schema.format("query_id")),
                       spark.createDataFrame(corpus, schema.format("item_id")), k=4, **blocks).collect()
        assert sorted(tuple(r) for r in got) == [("q", 1, "a", 1.0), ("q", 2, "b", 0.0), ("z", 1, "a", 0.0), ("z", 2, "b", 0.0)]


def test_every_save_is_kept_and_searched(spark):
    from pyspark.sql import functions as F

    from convlytics.functions.embedders import DigestEmbedder
    from convlytics.operators.embed import embed_rows
    from convlytics.operators.memory import hits_context, search_memory
    from convlytics.session import scratch_path
    from convlytics.sources.stores import append_memory, load_memory

    emb, path = DigestEmbedder(), scratch_path(spark, "mem-saves")

    def save(text, save_id):
        rows = spark.createDataFrame([("i", text)], "item_id string, text string").withColumn(
            "metadata", F.create_map(F.lit("thread_id"), F.lit("t")))
        append_memory(embed_rows(rows, emb, emb.name, text_col="text", key_col="item_id", carry=("text", "metadata")), path, save_id)

    save("old", "1")
    save("new", "2")
    save("new", "2")  # written again after a failure
    store = load_memory(spark, path)
    assert sorted(r.text for r in store.collect()) == ["new", "old"]
    hits = search_memory(spark.createDataFrame([("q", "old")], "question_id string, question string"), store, emb, emb.name, k=5)
    got = sorted(hits.collect(), key=lambda r: r.rank)
    assert [(r.text, r.save_id, r.metadata["thread_id"]) for r in got] == [("old", "1", "t"), ("new", "2", "t")]
    assert abs(got[0].score - 1) < 1e-9 and hits_context(hits).first().context == "- old\n- new"


def test_block_counts_respect_caps_and_balance():
    from convlytics.operators.memory import _block_counts

    for nq, nc in [(10**9, 10**6), (10**6, 10**6), (10**4, 10**7), (5, 5)]:
        qb, cb = _block_counts(nq, nc, 20_000, 20_000, 400_000_000)
        assert -(-nq // qb) <= 20_000 and -(-nc // cb) <= 20_000
        assert (-(-nq // qb)) * (-(-nc // cb)) <= 400_000_000 * 1.01 + 20_000
    qb, cb = _block_counts(10**6, 10**6, 20_000, 20_000, 400_000_000)
    assert 10**6 * cb + 10**6 * qb <= 1.1 * 10**8


def test_rows_are_copied_to_few_blocks(spark, monkeypatch):
    """However small the blocks that are asked for, what is shuffled is a fixed multiple of the input; in rounds, too."""
    import convlytics.operators.memory as M

    rng = np.random.default_rng(17)
    q, c = rng.normal(size=(300, 8)), rng.normal(size=(300, 8))
    moved, ranked = [], M._ranked
    monkeypatch.setattr(M, "_ranked", lambda sides, *a: moved.append(sides.count()) or ranked(sides, *a))
    want = {i: [h[0] for h in hits] for i, hits in _brute(q, c, 3).items()}
    for held, rounds in ((64 << 20, 1), (8 * 8 * 30, 3)):
        monkeypatch.setattr(M, "BLOCK_BYTES", held)
        for cells in (0, 9):
            moved.clear()
            got = {}
            for r in knn_topk(_frame(spark, "query_id", q), _frame(spark, "item_id", c), k=3, block_bytes=8 * 8 * 4,
                              pairs_per_task=20, cells=cells).collect():
                got.setdefault(r.query_id, []).append((r.rank, r.item_id))
            assert {i: [h[1] for h in sorted(hits)] for i, hits in got.items()} == want
            assert max(moved) <= 600 * 12 and len(moved) == rounds * (1 + (cells > 0))


class _Function:
    """In place of a table: keeps the function that tasks would run."""

    schema: list = []

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    def withColumn(self, *_):  # noqa: N802
        return self


def _peak_mb(batches) -> float:
    import tracemalloc

    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in batches)
        assert n
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_visit_holds_the_bounds_of_few_queries(spark):
    import pyarrow as pa

    import convlytics.operators.memory as M

    rng = np.random.default_rng(18)
    plan = M.Cells(np.linalg.norm(rng.normal(size=(2000, 4, 1)), axis=2))
    plan.measure([{"cell": i, "n": 10, "angle": 0.1, "low": 1.0, "high": 1.0} for i in range(2000)], 5000)
    v = rng.normal(size=(4000, 4))
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(4000)], "v": pa.array(v.tolist(), pa.list_(pa.float64())),
                                        "reached": pa.array([None] * 4000, pa.float64())})
    table = _Function()
    M.visits(table, plan, 3, 4)
    assert _peak_mb(table.run(iter([batch]))) < 60  # one matrix of all bounds has 64


def test_embedding_holds_few_texts(spark):
    import pyarrow as pa

    from convlytics.functions.embedders import HashingEmbedder
    from convlytics.operators.embed import embed_rows

    batch = pa.RecordBatch.from_pydict({"text_hash": [str(i) for i in range(10_000)], "chunk": ["a b c"] * 10_000})
    table = embed_rows(_Function(), HashingEmbedder(64), "m")
    assert _peak_mb(table.run(iter([batch]))) < 10
