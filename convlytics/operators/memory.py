"""Semantic memory: saved question/answer texts, exact top-k vector search.

The store is a Parquet table (item_id, save_id, text, metadata, embedding)
that is only appended to; every save is kept.  Search is exact inner product
over L2-normalised vectors (cosine similarity), computed block by block:

* queries are hash-split into ``Qb`` blocks and the corpus into ``Cb``
  blocks; a block side is bounded in bytes of vectors, a task in scored
  pairs, and Qb / Cb follows |Q| / |C|, which minimises the rows replicated;
* there are no more blocks a side than keep all cores busy (``most_blocks``),
  as each query row is replicated to the ``Cb`` corpus blocks and each corpus
  row to the ``Qb`` query blocks: what is shuffled grows as the input does.
  Beyond that blocks are larger instead.  A task holds its queries only, the
  items come in order of their ids, batch by batch; queries of more than
  ``BLOCK_BYTES`` a block are searched in rounds;
* a task scores tiles of ``TILE`` queries by ``TILE`` items and carries its
  local top-k from tile to tile, so the score matrix in memory does not grow
  with either side;
* a final ``row_number`` per query keeps the global top-k from the
  ``Cb * k`` candidates (exact: local top-k with the same total order).

More pairs than one task may score are pruned first, and the result stays exact:

* ``MAX_CELLS`` vectors of the corpus at most, chosen by hash, are centres; a
  vector belongs to the cell of its nearest centre, and a cell's angular radius
  is the largest angle that one of its vectors has.  By the triangle inequality
  no vector of a cell scores more with a query than the cosine of the query's
  angle to the centre less the radius, times the norms;
* every query first visits the cells with the best bounds, which gives it a
  k-th score; then it visits all cells whose bound that score does not beat.
  Corpus rows go to one block of cells each, and queries only to the blocks
  that they visit.

Centres, radii and sizes are what the driver holds (16 MB at most); the other
vectors never pass through it.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlytics.functions.vectors import l2_normalize
from convlytics.session import scratch_path

# Default number of hits, and the answer template.
DEFAULT_K = 4
CONTEXT_K = 3
QUESTION_PREFIX = "Pregunta: "
ANSWER_PREFIX = "\nRespuesta: "

# Bytes of float64 vectors on one side of a block pair, and of the queries that a
# task may hold; scored pairs allowed per task while blocks are few; the side of a
# tile of scores, and the queries whose bounds are held at a time.
BLOCK_BYTES = 64 << 20
PAIRS_PER_TASK = 400_000_000
TILE = 1024
BOUND_ROWS = 256
# Cells of the pruned search, bytes of their centres, and the slack of a bound
# for the rounding of angles.
MAX_CELLS, CENTRE_BYTES, SLACK = 2048, 16 << 20, 1e-7
HITS_SCHEMA = "query_id string, rank int, item_id string, score double"


def memory_text(question, answer):
    """'Pregunta: <q>\\nRespuesta: <a>'."""
    return F.concat(F.lit(QUESTION_PREFIX), question, F.lit(ANSWER_PREFIX), answer)


def memory_items(df: DataFrame, question_col: str, answer_col: str, id_col: str,
                 thread_col: str | None = None, session_col: str | None = None) -> DataFrame:
    """(item_id, text, metadata) for rows with a non-empty answer."""
    meta = F.create_map(
        F.lit("thread_id"), (F.col(thread_col).cast("string") if thread_col else F.lit(None).cast("string")),
        F.lit("session_id"), (F.col(session_col).cast("string") if session_col else F.lit(None).cast("string")),
    )
    return (
        df.filter(F.col(answer_col).isNotNull() & (F.col(answer_col) != ""))
        .select(F.col(id_col).cast("string").alias("item_id"),
                memory_text(F.coalesce(F.col(question_col), F.lit("")), F.col(answer_col)).alias("text"),
                meta.alias("metadata"))
    )


def _block_counts(n_q: int, n_c: int, max_q_rows: int, max_c_rows: int,
                  pairs_per_task: int = PAIRS_PER_TASK) -> tuple[int, int]:
    """(query blocks, corpus blocks) for the blocked search.

    Every task may score at most ``pairs_per_task`` pairs.  The rows
    shuffled are n_q * Cb + n_c * Qb; for a fixed task budget that is least
    when Qb / Cb = n_q / n_c, so the counts follow that ratio, and neither
    block may exceed its row cap (memory per task).
    """
    k = max(1.0, n_q * n_c / pairs_per_task)  # Qb * Cb needed
    qb = max(1, math.ceil(math.sqrt(k * n_q / max(n_c, 1))), math.ceil(n_q / max_q_rows) if n_q > 0 else 1)
    cb = max(1, math.ceil(k / qb), math.ceil(n_c / max_c_rows))
    return qb, cb


def most_blocks(spark: SparkSession) -> int:
    """Blocks a side at most: two block pairs for each core."""
    return max(4, math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)))


class TopK:
    """The ``k`` best items of each query, from items that come in ascending order of their ids.

    The total order is score descending, then id ascending; of rows with the
    same id the best counts.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.empty((len(queries), k), object)

    def add(self, ids: np.ndarray, items: np.ndarray, tile: int = TILE) -> None:
        """Scores are made tile by tile, and only those that reach a query's k-th are looked at."""
        for at in range(0, len(items), tile):
            some, names = items[at:at + tile].T, ids[at:at + tile]
            start = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            # copies of an item must not crowd others out
            slots = min(self.k * int(np.diff(np.append(start, len(names))).max()), self.k + len(names) - len(start))
            for lo in range(0, len(self.queries), tile):
                new = self.queries[lo:lo + tile] @ some
                least = self.score[lo:lo + tile, -1]
                with np.errstate(invalid="ignore"):
                    # later ids lose a tie; what rounding might lift above is kept
                    floor = least + 2.5e-13 - 1e-15 * np.abs(least)
                few = np.flatnonzero(np.isneginf(least))
                floor[few] = -np.inf
                if len(few) and slots < len(names):
                    nth = np.partition(new[few], -slots, axis=1)[:, -slots]
                    floor[few] = nth - 1e-12 - 1e-15 * np.abs(nth)
                row, col = np.nonzero(new > floor[:, None])
                if len(row):
                    value = np.round(new[row, col], 12)  # equal vectors tie, however BLAS sums
                    cut = np.flatnonzero(np.diff(row)) + 1
                    for r, c, v in zip(row[np.append(0, cut)].tolist(), np.split(col, cut), np.split(value, cut)):
                        self._merge(lo + r, names[c], v)

    def _merge(self, row: int, names: np.ndarray, value: np.ndarray) -> None:
        value = np.append(self.score[row], value)
        names = np.append(self.id[row], names)
        seen: dict = {}
        for i in np.argsort(-value, kind="stable").tolist():  # what was held has the smaller ids
            if value[i] == -np.inf or len(seen) == self.k:
                break
            seen.setdefault(names[i], value[i])
        self.id[row, :len(seen)] = list(seen)
        self.score[row, :len(seen)] = list(seen.values())


def block_topk(queries: np.ndarray, items: np.ndarray, order: np.ndarray, k: int, tile: int = TILE):
    """Positions and scores (queries by at most k) of the best items.

    ``order`` is each item's place in ascending id order; the total order is
    score descending, then id ascending.  Scores are made tile by tile.
    """
    at = np.argsort(order, kind="stable")
    best = TopK(queries, min(k, len(items)))
    best.add(np.arange(len(items)), items[at], tile)
    return at[best.id.astype(np.int64)], best.score


def _usable(vec: str, dim: int):
    """Rows whose vector has the corpus's length and finite numbers only."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & ~bad


def _vectors(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """The vectors of a batch, rows by components."""
    v = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return v.reshape(batch.num_rows, -1).astype(np.float64, copy=False)


def _slices(batches, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _pair_topk(k: int):
    """Scores the block pairs of a partition, each pair's queries first and then its items by id."""
    def run(batches):
        held, queries, best = None, [], None

        def out():
            if best is not None:
                row, col = np.nonzero(best.score > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(best.id[row, col], pa.string()), pa.array(best.score[row, col])],
                    ["qid", "iid", "score"])

        for b in _slices(batches, 1 << 14):
            pair = b.column("pair").to_numpy()
            cut = np.append(np.flatnonzero(np.diff(pair)) + 1, b.num_rows)
            for lo, hi in zip(np.append(0, cut).tolist(), cut.tolist()):
                if held != pair[lo]:
                    yield from out()
                    held, queries, best = pair[lo], [], None
                part = b.slice(lo, hi - lo)
                asked = part.column("is_query").to_numpy(zero_copy_only=False)
                n = int(asked.sum())
                if n:
                    queries.append((part.column("id").take(pa.array(np.arange(n))), _vectors(part.slice(0, n)).copy()))  # else the batch is kept
                if n < len(asked) and (queries or best):
                    if best is None:
                        ids = pa.concat_arrays([q[0] for q in queries])
                        best, queries = TopK(np.concatenate([q[1] for q in queries]), k), []
                    part = part.slice(n)
                    best.add(part.column("id").to_numpy(zero_copy_only=False), _vectors(part))
        yield from out()

    return run


def _ranked(sides: DataFrame, keys: tuple[str, str], k: int) -> DataFrame:
    """(query_id, rank, item_id, score) from queries and items that meet by ``keys``, numbers of blocks."""
    most = most_blocks(sides.sparkSession)  # of query blocks; pruned searches may have more of the corpus
    pair = (F.col(keys[1]) * most + F.col(keys[0])).cast("int")
    cand = (sides.withColumn("pair", pair).repartitionById(2 * most * most, "pair")
            .sortWithinPartitions("pair", F.col("is_query").desc(), "id").select("pair", "is_query", "id", "v")
            .mapInArrow(_pair_topk(k), "qid string, iid string, score double")
            .groupBy("qid", "iid").agg(F.max("score").alias("score")))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("iid").asc())
    return (
        cand.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select(F.col("qid").alias("query_id"), "rank", F.col("iid").alias("item_id"), "score")
    )


class Cells:
    """Centres, angular radii, norms and sizes of a corpus's cells, and the blocks they lie in."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def angles(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(norms, angles to all centres); a zero vector has the angle 0."""
        norm = np.linalg.norm(vectors, axis=1)
        unit = np.divide(vectors, norm[:, None], out=np.zeros_like(vectors), where=norm[:, None] > 0)
        angle = np.arccos(np.clip(unit @ self.centres.T, -1, 1))
        angle[norm == 0] = 0
        return norm, angle

    def measure(self, rows: list, block_rows: int) -> None:
        """Sets radii and sizes from (cell, n, angle, low, high) and lays the cells out in blocks."""
        m = len(self.centres)
        self.size, self.radius = np.zeros(m, np.int64), np.zeros(m)
        self.low, self.high = np.zeros(m), np.zeros(m)
        for r in rows:
            c = r["cell"]
            self.size[c], self.radius[c], self.low[c], self.high[c] = r["n"], r["angle"], r["low"], r["high"]
        self.first, self.parts = np.zeros(m, np.int64), np.ones(m, np.int64)
        block, held = 0, 0
        for c in range(m):  # small cells share a block, large ones are split by hash
            if held and held + self.size[c] > block_rows:
                block, held = block + 1, 0
            self.parts[c] = max(1, -(-int(self.size[c]) // block_rows))
            self.first[c] = block
            held += int(self.size[c])
            if self.parts[c] > 1:
                block, held = block + int(self.parts[c]), 0
        self.blocks = block + 1

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no vector of a cell scores more than, for each query and cell."""
        norm, angle = self.angles(queries)
        cos = np.cos(np.maximum(0, angle - self.radius))
        bound = norm[:, None] * np.where(cos >= 0, self.high, self.low) * cos
        bound[norm == 0] = 0
        return np.where(self.size > 0, bound + SLACK * np.maximum(1, norm[:, None] * self.high), -np.inf)


def corpus_cells(items: DataFrame, n: int, dim: int, cells: int, block_rows: int) -> tuple[Cells, DataFrame]:
    """The cells of ``items`` (id, v), and the items with their ``block`` in a written table."""
    spark = items.sparkSession
    m = max(1, min(cells, CENTRE_BYTES // (8 * dim)))
    some = np.array([r["v"] for r in items.orderBy(F.xxhash64("id"), "id").limit(m).collect()], np.float64).reshape(-1, dim)
    norm = np.linalg.norm(some, axis=1)
    centres = np.unique(some[norm > 0] / norm[norm > 0, None], axis=0)
    plan = Cells(centres if len(centres) else np.eye(1, dim))

    def assign(batches):
        for b in _slices(batches, BOUND_ROWS):
            norm, angle = plan.angles(_vectors(b))
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell]), pa.array(norm)],
                ["id", "v", "cell", "angle", "norm"])

    path = scratch_path(spark, "cells")
    items.mapInArrow(assign, "id string, v array<double>, cell int, angle double, norm double").write.parquet(path)
    placed = spark.read.parquet(path)
    plan.measure(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.min("norm").alias("low"),
                                            F.max("norm").alias("high")).collect(), block_rows)
    first, parts = (F.array(*[F.lit(int(x)) for x in a]) for a in (plan.first, plan.parts))
    block = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("id", "v"), F.get(parts, F.col("cell")))
    return plan, placed.select("id", "v", block.cast("long").alias("block"))


def visits(queries: DataFrame, plan: Cells, k: int, n_qb: int) -> DataFrame:
    """(id, v, qb, block, pairs): the blocks that each query (id, v, reached) visits.

    Without a score that it has ``reached`` a query visits the cells with the
    best bounds, until they hold twice ``k`` vectors; with one all cells whose
    bound is no less.  ``pairs`` counts the vectors that are scored there.
    """
    def run(batches):
        for b in _slices(batches, BOUND_ROWS):
            bound = plan.bounds(_vectors(b))
            at, block, pairs = [], [], []
            for i, (near, reached) in enumerate(zip(bound, b.column("reached").to_numpy(zero_copy_only=False))):
                if np.isnan(reached):
                    best = np.argsort(-near, kind="stable")
                    use = best[:int(np.searchsorted(np.cumsum(plan.size[best]), 2 * k)) + 1]
                else:
                    use = np.flatnonzero(near >= reached)
                use = use[plan.size[use] > 0]
                of = np.unique(np.concatenate([np.arange(f, f + p) for f, p in zip(plan.first[use], plan.parts[use])] or [[]]))
                at += [i] * len(of)
                block += of.tolist()
                pairs += [int(plan.size[use].sum())] * len(of)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("v").take(at), pa.array(block, pa.int64()),
                                              pa.array(pairs, pa.int64())], ["id", "v", "block", "pairs"])

    went = queries.select("id", "v", "reached").mapInArrow(run, "id string, v array<double>, block long, pairs long")
    return went.withColumn("qb", F.pmod(F.xxhash64("id", F.hash("v")), F.lit(n_qb)))


def _visited(went: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The best k items of every query in the blocks it visits."""
    q = went.select(F.lit(True).alias("is_query"), "id", "v", "qb", "block")
    c = items.join(F.broadcast(went.select("qb", "block").distinct()), "block").select(F.lit(False).alias("is_query"), "id", "v", "qb", "block")
    return _ranked(q.unionByName(c), ("qb", "block"), k)


def _pruned_topk(queries: DataFrame, placed: DataFrame, plan: Cells, k: int, n_qb: int) -> DataFrame:
    """Two rounds of visits; see the module."""
    start = visits(queries.withColumn("reached", F.lit(None).cast("double")), plan, k, n_qb)
    kth = (_visited(start, placed, k).where(F.col("rank") == k)
           .select(F.col("query_id").alias("id"), F.col("score").alias("reached")))
    known = queries.join(kth, "id", "left").select("id", "v", F.coalesce("reached", F.lit(float("-inf"))).alias("reached"))
    return _visited(visits(known, plan, k, n_qb), placed, k)


def _whole_topk(q: DataFrame, c: DataFrame, k: int, n_qb: int, n_cb: int) -> DataFrame:
    """All pairs of blocks."""
    q = q.select(F.lit(True).alias("is_query"), "id", "v", F.pmod(F.xxhash64("id", F.hash("v")), F.lit(n_qb)).alias("qb"),
                 F.explode(F.sequence(F.lit(0), F.lit(n_cb - 1))).alias("cb"))
    c = c.select(F.lit(False).alias("is_query"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))).alias("qb"),
                 F.pmod(F.xxhash64("id", F.hash("v")), F.lit(n_cb)).alias("cb"))
    return _ranked(q.unionByName(c), ("qb", "cb"), k)


def _in_rounds(q: DataFrame, rounds: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The hits of one share of the queries after the other; all vectors of an id are in one share."""
    if rounds == 1:
        return search(q)
    spark = q.sparkSession
    path = scratch_path(spark, "hits")
    for i in range(rounds):
        search(q.where(F.pmod(F.xxhash64(F.lit("round"), "id"), F.lit(rounds)) == i)).write.mode("append").parquet(path)
        # the files of a shuffle go when the driver collects its garbage
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(HITS_SCHEMA).parquet(path)


def knn_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    query_id: str = "query_id",
    item_id: str = "item_id",
    query_vec: str = "embedding",
    item_vec: str = "embedding",
    normalize: bool = True,
    block_bytes: int = BLOCK_BYTES,
    pairs_per_task: int = PAIRS_PER_TASK,
    cells: int | None = None,
) -> DataFrame:
    """(query_id, rank, item_id, score): the ``k`` best items per query.

    Rank 1 is the highest score; ties go to the smaller item id.  Fewer than
    ``k`` items give fewer hits; an empty corpus gives none.  A vector that is
    NULL, not as long as the corpus's longest, or holds a NULL, NaN or
    infinite number gives no hits and is none; a zero vector scores 0 with
    everything.  An id on several rows is one query, or one item, with the
    best score that any of its vectors reaches.  ``block_bytes`` and
    ``pairs_per_task`` set the blocks while there are no more than
    :func:`most_blocks` a side.  ``cells`` sets the number of cells of the
    pruned search, 0 for none; without it searches of more pairs than one
    task's use about the square root of the corpus.
    """
    spark = queries.sparkSession
    shape = corpus.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.col(item_vec))).alias("d")).first()
    n, dim = shape["n"], shape["d"] or 0
    if k <= 0 or dim <= 0:
        return spark.createDataFrame([], HITS_SCHEMA)
    vec = l2_normalize if normalize else (lambda c: F.transform(F.col(c), lambda x: x.cast("double")))
    rows = max(1, block_bytes // (8 * dim))
    n_q = queries.count()
    n_qb, n_cb = _block_counts(n_q, n, rows, rows, pairs_per_task)
    most = most_blocks(spark)
    rounds = 1
    if n_qb > most:  # a task holds its queries whole: up to BLOCK_BYTES of them a round
        rounds = max(1, math.ceil(n_q / (most * max(rows, BLOCK_BYTES // (8 * dim)))))
    n_qb, n_cb = min(n_qb, most), min(n_cb, most)
    q = queries.filter(_usable(query_vec, dim)).select(F.col(query_id).cast("string").alias("id"), vec(query_vec).alias("v"))
    c = corpus.filter(_usable(item_vec, dim)).select(F.coalesce(F.col(item_id).cast("string"), F.lit("None")).alias("id"), vec(item_vec).alias("v"))
    if cells is None:
        cells = min(MAX_CELLS, math.isqrt(n)) if n_q * n > pairs_per_task else 0
    if cells:
        plan, placed = corpus_cells(c, n, dim, cells, max(1, math.ceil(n / n_cb)))
        return _in_rounds(q, rounds, lambda some: _pruned_topk(some, placed, plan, k, n_qb))
    return _in_rounds(q, rounds, lambda some: _whole_topk(some, c, k, n_qb, n_cb))


def search_memory(questions: DataFrame, store: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]],
                  model: str, k: int = CONTEXT_K, id_col: str = "question_id", question_col: str = "question",
                  **blocks) -> DataFrame:
    """(query_id, rank, item_id, save_id, text, metadata, score): what the store holds nearest to each question.

    Questions are embedded with the model that embedded the saved texts; each
    save is an item of its own.
    """
    from convlytics.operators.embed import embed_rows

    asked = questions.select(F.col(id_col).cast("string").alias("query_id"), F.col(question_col).alias("chunk"))
    vecs = embed_rows(asked, embed_fn, model, text_col="chunk", key_col="query_id")
    key = F.concat_ws("\u0001", "item_id", F.coalesce("save_id", F.lit("")))
    saved = store.withColumn("_key", key)
    hits = knn_topk(vecs, saved, k=k, item_id="_key", **blocks).withColumnRenamed("item_id", "_key")
    return (hits.join(saved.select("_key", "item_id", "save_id", "text", "metadata"), "_key")
            .select("query_id", "rank", "item_id", "save_id", "text", "metadata", "score"))


def hits_context(hits: DataFrame) -> DataFrame:
    """Per query: '- <text>' lines of :func:`search_memory` hits, in rank order."""
    return hits.groupBy("query_id").agg(
        F.expr("listagg(concat('- ', text), '\\n') WITHIN GROUP (ORDER BY rank)").alias("context"))


def semantic_context(hits: DataFrame, corpus: DataFrame, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per query: '- <text>' lines of its hits, in rank order, joined by newline."""
    texts = corpus.select(F.col(item_id).cast("string").alias("item_id"), F.col(text_col).alias("_text"))
    return hits_context(hits.join(texts, "item_id", "inner").select("query_id", "rank", F.col("_text").alias("text")))
