"""Chunking, content-hash embedding cache, batch embedding and mean pooling.

Plan:

* chunks are produced by native array expressions + ``posexplode``;
* cache misses are ``dropDuplicates(text_hash)`` followed by a left-anti join
  with the cache on ``(model, text_hash)`` -- one shuffle on the hash, and none
  of the cache, which lies in buckets of it; a small batch of chunks reads only
  the buckets of its hashes;
* the embedding model runs in ``mapInArrow`` over slices of Arrow batches, opened
  once a worker, in calls of texts of like length; the result is appended to the cache (the write
  is the action, so the model runs exactly once per missing chunk);
* pooling joins chunks to cached vectors and averages them per document
  with ``Summarizer.mean`` (map-side partial aggregation, fixed-size buffer).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlytics.errors import EmbeddingError
from convlytics.functions.embedders import EmbedFn, ModelFactory, call_slices, opened
from convlytics.functions.text import CHUNK_WORDS, chunk_word_array, sha256_hex, words
from convlytics.sources import cache as stores

# Fixed value: texts per call of the embedding function.
EMBED_BATCH = 64
#: texts that a worker holds as Python strings, with their vectors
SLICE_ROWS = 512
#: chunks up to which a fill looks its hashes up instead of joining the whole cache
FEW_CHUNKS = 2000


def chunk_texts(df: DataFrame, id_col: str, text_col: str, chunk_size: int = CHUNK_WORDS) -> DataFrame:
    """(id, chunk_pos, chunk, text_hash): one row per chunk, in order."""
    # the word array is projected once; the chunk lambda then slices the column
    w = df.select(F.col(id_col), words(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    exploded = w.select(F.col(id_col), F.posexplode(chunk_word_array("_w", chunk_size)).alias("chunk_pos", "chunk"))
    return exploded.withColumn("text_hash", sha256_hex("chunk"))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per distinct chunk hash."""
    return chunks.select("text_hash", "chunk").dropDuplicates(["text_hash"])


def cache_misses(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct chunks with no cached vector for ``model``."""
    cached = cache.filter(F.col("model") == model).select("text_hash")
    return distinct_chunks(chunks).join(cached, "text_hash", "left_anti")


def embed_rows(
    rows: DataFrame,
    embed_fn: EmbedFn | ModelFactory,
    model: str,
    batch_size: int = EMBED_BATCH,
    text_col: str = "chunk",
    key_col: str = "text_hash",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(model, key, embedding) for each row, in calls of ``batch_size`` texts at most.

    ``embed_fn`` is a function, or a :class:`ModelFactory` that each Python
    worker opens once.  Texts of like length are called together, within the
    factory's budget of tokens, and results come in the order of the rows.
    Columns named in ``carry`` come along, so that nothing has to be joined back.
    """

    def run(batches):
        embed = opened(embed_fn)
        budget = getattr(embed_fn, "max_tokens", None)
        for b in (b.slice(lo, SLICE_ROWS) for b in batches for lo in range(0, b.num_rows, SLICE_ROWS)):
            texts = ["" if t is None else t for t in b.column(text_col).to_pylist()]
            sizes = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
            vecs: list = [None] * len(texts)
            for at in call_slices(sizes, batch_size, budget):
                got = embed([texts[i] for i in at])
                if len(got) != len(at):
                    raise EmbeddingError("embedding function returned a wrong number of vectors")
                for i, v in zip(at.tolist(), got):
                    vecs[i] = v
            yield pa.RecordBatch.from_arrays(
                [pa.array([model] * len(texts), pa.string()), b.column(key_col), pa.array(vecs, pa.list_(pa.float32())),
                 *[b.column(c) for c in carry]], ["model", key_col, "embedding", *carry])

    out = T.StructType([T.StructField("model", T.StringType()), T.StructField(key_col, T.StringType()),
                        T.StructField("embedding", T.ArrayType(T.FloatType())), *[rows.schema[c] for c in carry]])
    src = rows.select(F.col(key_col).cast("string").alias(key_col),
                      *[c for c in dict.fromkeys((text_col, *carry)) if c != key_col])
    return src.mapInArrow(run, schema=out)


def fill_cache(
    spark: SparkSession,
    chunks: DataFrame,
    cache_path: str,
    embed_fn: EmbedFn | ModelFactory,
    model: str,
    batch_size: int = EMBED_BATCH,
) -> DataFrame:
    """Embed the cache misses of ``chunks`` and append them to the cache at ``cache_path``.

    The vectors are written once, marked with this call's batch id; the rows
    returned are read back by it, so the model is not re-run by lineage.
    Re-running on the same chunks adds nothing.
    """
    few = chunks.select("text_hash").limit(FEW_CHUNKS + 1).collect()
    hashes = sorted({r["text_hash"] for r in few}) if len(few) <= FEW_CHUNKS else None
    cache = stores.load_cache(spark, cache_path, model, hashes)
    misses = cache_misses(chunks, cache, model)
    batch_id = uuid.uuid4().hex
    stores.append_cache(embed_rows(misses, embed_fn, model, batch_size).withColumn("batch_id", F.lit(batch_id)), cache_path)
    return stores.cache_rows(spark, cache_path).filter(F.col("batch_id") == batch_id).drop("batch_id")


def mean_pool(chunk_vectors: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors per ``id_col`` (each chunk row counts once)."""
    pooled = chunk_vectors.groupBy(id_col).agg(
        Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_mean")
    )
    return pooled.select(id_col, vector_to_array("_mean").alias(vec_col))


def pool_documents(chunks: DataFrame, cache: DataFrame, id_col: str, model: str) -> DataFrame:
    """Join chunks to cached vectors on the hash and mean-pool them per document.

    Documents with zero chunks produce no row.
    """
    vecs = cache.filter(F.col("model") == model).select("text_hash", "embedding")
    return mean_pool(chunks.select(id_col, "text_hash").join(vecs, "text_hash", "inner"), id_col)


def embed_documents(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str,
    text_col: str,
    cache_path: str,
    embed_fn: EmbedFn | ModelFactory,
    model: str,
    batch_size: int = EMBED_BATCH,
    chunk_size: int = CHUNK_WORDS,
) -> DataFrame:
    """Full path: chunk -> hash -> cache misses -> embed -> append -> mean pool."""
    if docs.isEmpty():
        raise EmbeddingError("no texts to embed")
    chunks = chunk_texts(docs, id_col, text_col, chunk_size)
    fill_cache(spark, chunks, cache_path, embed_fn, model, batch_size)
    cache = stores.load_cache(spark, cache_path, model)
    return pool_documents(chunks, cache, id_col, model)
