"""Keep the embedding cache and the answer memory filled from a stream.

The reference has no streaming operators; its two stores are insert-only
and keyed (``(model, text_hash)`` and ``(save_id, item_id)``), so each micro-batch can
run the batch operator unchanged inside ``foreachBatch``.  A replayed batch
after a failure adds nothing (cache misses are computed by anti-join; a batch's
epoch is its ``save_id``, and a save that is committed is not written again), so the
sink is idempotent and the query can restart from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from convlytics.functions.text import CHUNK_WORDS
from convlytics.operators.embed import EMBED_BATCH, chunk_texts, fill_cache


def stream_embedding_cache(
    texts: DataFrame,
    id_col: str,
    text_col: str,
    cache_path: str,
    embed_fn: Callable[[list[str]], list[list[float]]],
    model: str,
    checkpoint_location: str,
    batch_size: int = EMBED_BATCH,
    chunk_size: int = CHUNK_WORDS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that embeds the new chunks of every micro-batch into the cache."""

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        chunks = chunk_texts(batch, id_col, text_col, chunk_size)
        fill_cache(batch.sparkSession, chunks, cache_path, embed_fn, model, batch_size)

    writer = texts.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def stream_memory(
    answers: DataFrame,
    to_items: Callable[[DataFrame], DataFrame],
    memory_path: str,
    embed_fn: Callable[[list[str]], list[list[float]]],
    model: str,
    checkpoint_location: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that turns each micro-batch into memory items and appends them.

    ``to_items`` maps a batch to ``(item_id, text, metadata)`` rows, e.g.
    strict-JSON answers through :func:`convlytics.operators.memory.memory_items`.
    """
    from convlytics.operators.embed import embed_rows
    from convlytics.sources.stores import append_memory

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        vecs = embed_rows(to_items(batch), embed_fn, model, text_col="text", key_col="item_id", carry=("text", "metadata"))
        # a replayed batch whose save was committed writes nothing
        append_memory(vecs, memory_path, save_id=f"epoch-{epoch_id}")

    writer = answers.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
