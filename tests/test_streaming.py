"""Streaming fill of the embedding cache: incremental and idempotent."""

from convlytics.functions.embedders import HashingEmbedder
from convlytics.session import scratch_path
from convlytics.sources.stores import load_cache
from convlytics.streaming.incremental import stream_embedding_cache


def test_stream_fills_cache_incrementally(spark):
    src = scratch_path(spark, "stream-src")
    spark.createDataFrame([(1, "a b c d"), (2, "a b")], "id int, t string").write.parquet(src)
    cache, ckpt = scratch_path(spark, "stream-cache"), scratch_path(spark, "stream-ckpt")
    emb = HashingEmbedder(4)

    def run():
        q = stream_embedding_cache(spark.readStream.schema("id int, t string").parquet(src), "id", "t",
                                   cache, emb, "h4", ckpt, chunk_size=2)
        q.awaitTermination(120)

    run()
    assert load_cache(spark, cache, "h4").count() == 2  # 'a b', 'c d'
    spark.createDataFrame([(3, "c d e f")], "id int, t string").write.mode("append").parquet(src)
    run()
    assert load_cache(spark, cache, "h4").count() == 3  # + 'e f'


def test_stream_memory_is_idempotent(spark):
    from convlytics.operators.memory import memory_items
    from convlytics.sources.stores import load_memory
    from convlytics.streaming.incremental import stream_memory

    src = scratch_path(spark, "answers-src")
    rows = [("q1", "hola", '{"summary": "s"}', "t1"), ("q2", "adios", "", "t2")]
    spark.createDataFrame(rows, "qid string, question string, answer string, thread string").write.parquet(src)
    mem, ckpt = scratch_path(spark, "mem"), scratch_path(spark, "mem-ckpt")
    emb = HashingEmbedder(4)

    def to_items(batch):
        return memory_items(batch, "question", "answer", "qid", "thread", "thread")

    schema = "qid string, question string, answer string, thread string"
    stream_memory(spark.readStream.schema(schema).parquet(src), to_items, mem, emb, "h4", ckpt).awaitTermination(120)
    # same rows again under a new checkpoint: a replay must not duplicate items
    stream_memory(spark.readStream.schema(schema).parquet(src), to_items, mem, emb, "h4",
                  scratch_path(spark, "mem-ckpt2")).awaitTermination(120)
    got = load_memory(spark, mem).collect()
    assert [r.item_id for r in got] == ["q1"] and got[0].text == 'Pregunta: hola\nRespuesta: {"summary": "s"}'
