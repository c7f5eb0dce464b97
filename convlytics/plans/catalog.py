"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads whole driver tables (or data Spark derives from them);
double outputs are rounded to 6 places so they compare with the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlytics.functions.labels import coerce_label
from convlytics.operators import master as M
from convlytics.operators import metrics as MT
from convlytics.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def master_orders(spark: SparkSession, sf_dir: str, thread_ids: DataFrame | None = None) -> DataFrame:
    # the driver's tables have rows; ``build_strict_master`` runs the check
    return M.build_master(T.threads(spark, sf_dir), T.messages(spark, sf_dir), thread_ids=thread_ids, strict=False)


# --------------------------------------------------------------------------- master


@query("conversation_agg")
def conversation_agg(spark, sf_dir):
    a = M.conversation_aggregate(T.messages(spark, sf_dir))
    return a.select("thread_id", "full_conversation", "msg_count", "first_msg", "last_msg")


@query("conversation_agg_text")
def conversation_agg_text(spark, sf_dir):
    """Ordered text of real conversation turns (no timestamps: order by turn)."""
    a = M.conversation_aggregate(T.messages_text(spark, sf_dir), seq_col="seq")
    return a.select("thread_id", "full_conversation", "msg_count")


@query("conversation_agg_events")
def conversation_agg_events(spark, sf_dir):
    """Per-user event log as conversations: JSON bodies ordered by microsecond time."""
    a = M.conversation_aggregate(T.messages_user(spark, sf_dir))
    return a.select("thread_id", "full_conversation", "msg_count", "first_msg", "last_msg",
                    r6(F.col("first_msg").cast("double")).alias("first_epoch_s"))


@query("master_table")
def master_table(spark, sf_dir):
    m = master_orders(spark, sf_dir)
    return m.select(
        "thread_id", "created_at", "status", "platform", "escalate_conversation",
        "full_conversation", "msg_count", "first_msg", "last_msg", r6("duration_minutes").alias("duration_minutes"),
    )


@query("threads_without_messages")
def threads_without_messages(spark, sf_dir):
    return M.threads_without_messages(T.threads(spark, sf_dir), T.messages(spark, sf_dir)).select(
        "thread_id", "status", "platform"
    )


@query("dropped_thread_count")
def dropped_thread_count(spark, sf_dir):
    return M.dropped_thread_count(T.threads(spark, sf_dir), T.messages(spark, sf_dir))


@query("duration_minutes")
def duration_minutes(spark, sf_dir):
    m = master_orders(spark, sf_dir)
    return m.select("thread_id", r6("duration_minutes").alias("duration_minutes"))


@query("label_coercion")
def label_coercion(spark, sf_dir):
    t = T.threads(spark, sf_dir)
    return t.select("thread_id", coerce_label("escalate_conversation").alias("escalation_flag"))


# --------------------------------------------------------------------------- metrics


@query("impact_metrics")
def impact_metrics(spark, sf_dir):
    out = MT.impact_metrics(master_orders(spark, sf_dir), strict=False)
    return out.select(*[r6(c).alias(c) if c != "estado_top" else F.col(c) for c in out.columns])


@query("top_status")
def top_status(spark, sf_dir):
    return MT.top_values(master_orders(spark, sf_dir), "status", 5).select(
        F.col("value").alias("status"), F.col("count").alias("n_threads")
    )


@query("escalation_by_category")
def escalation_by_category(spark, sf_dir):
    out = MT.escalation_by_category(master_orders(spark, sf_dir), "status", 8)
    return out.select("status", r6("escalation_rate").alias("escalation_rate"))


@query("escalation_by_platform")
def escalation_by_platform(spark, sf_dir):
    out = MT.escalation_by_category(master_orders(spark, sf_dir), "platform", 10)
    return out.select("platform", r6("escalation_rate").alias("escalation_rate"))


@query("escalation_by_volume")
def escalation_by_volume(spark, sf_dir):
    out = MT.escalation_by_volume(master_orders(spark, sf_dir))
    return out.select("msg_bucket", "bucket_order", r6("escalation_rate").alias("escalation_rate"), "n_threads")


@query("monthly_trend")
def monthly_trend(spark, sf_dir):
    out = MT.monthly_trend(master_orders(spark, sf_dir))
    return out.select("month", r6("escalation_rate").alias("escalation_rate"))


@query("operating_times")
def operating_times(spark, sf_dir):
    out = MT.operating_times(master_orders(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("context_summary")
def context_summary(spark, sf_dir):
    return MT.context_summary(master_orders(spark, sf_dir))


@query("top_threads_by_messages")
def top_threads_by_messages(spark, sf_dir):
    return MT.top_threads_by_messages(master_orders(spark, sf_dir), 5)


@query("top_threads_by_duration")
def top_threads_by_duration(spark, sf_dir):
    out = MT.top_threads_by_duration(master_orders(spark, sf_dir), 5)
    return out.select("thread_id", r6("duration_minutes").alias("duration_minutes"))


@query("conversation_lookup")
def conversation_lookup(spark, sf_dir):
    """Conversations of every order that has a returned line item."""
    li = T.read_table(spark, sf_dir, "lineitem")
    wanted = li.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("thread_id"))
    return MT.conversation_lookup(master_orders(spark, sf_dir, wanted), wanted)


@query("conversation_lookup_raw")
def conversation_lookup_raw(spark, sf_dir):
    """Raw-message fallback: newline-joined turns of every conversation with a user turn."""
    msgs = T.messages_text(spark, sf_dir)
    wanted = msgs.filter(F.col("role") == "user").select("thread_id")
    return MT.conversation_text_raw(msgs, wanted, seq_col="seq")


@query("metrics_json")
def metrics_json(spark, sf_dir):
    m = impact_metrics(spark, sf_dir)
    return MT.metrics_json(m)


# --------------------------------------------------------------------------- derived files

_DERIVED: dict[tuple, str] = {}


def events_json_path(spark: SparkSession, sf_dir: str) -> str:
    """Write the events table as JSON Lines messages with mixed value shapes.

    content: view -> object (props), click -> array [type, k, true],
    error -> null, signup -> padded text, purchase -> number.
    created_at: click -> {"$date": iso}, view -> iso text, purchase -> date
    only, error -> junk text, signup -> null.  Written once per session and
    table directory into the shared checkpoint folder.
    """
    from convlytics.session import scratch_path

    key = ("events_json", sf_dir, id(spark))
    if key in _DERIVED:
        return _DERIVED[key]
    e = T.read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    k = F.get_json_object("props", "$.k")
    content_json = (
        F.when(et == "view", F.col("props"))
        .when(et == "click", F.concat(F.lit('["'), et, F.lit('",'), k, F.lit(",true]")))
        .when(et == "error", F.lit("null"))
        .when(et == "signup", F.to_json(F.array(F.concat(F.lit("  "), F.col("props"), F.lit("\t"))))
              .substr(F.lit(2), F.length(F.to_json(F.array(F.concat(F.lit("  "), F.col("props"), F.lit("\t"))))) - 2))
        .otherwise(F.col("value").cast("string"))
    )
    date_json = (
        F.when(et == "click", F.concat(F.lit('{"$date":"'), iso, F.lit('"}')))
        .when(et == "view", F.concat(F.lit('"'), iso, F.lit('"')))
        .when(et == "purchase", F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"')))
        .when(et == "error", F.lit('"not a date"'))
        .otherwise(F.lit("null"))
    )
    # raw JSON text, so number spellings such as 13.0 reach the file unchanged
    line = F.concat(
        F.lit('{"event_id":'), F.col("event_id").cast("string"),
        F.lit(',"thread_id":"'), F.col("user_id").cast("string"),
        F.lit('","content":'), content_json,
        F.lit(',"created_at":'), date_json, F.lit("}"),
    )
    path = scratch_path(spark, "events-json")
    e.select(line.alias("value")).write.text(path)
    _DERIVED[key] = path
    return path


def json_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlytics.sources.json_source import read_json

    schema = "event_id long, thread_id string, content variant, created_at variant"
    return read_json(spark, events_json_path(spark, sf_dir), schema=schema, raw="content")


@query("src_json_messages")
def src_json_messages(spark, sf_dir):
    """JSON Lines messages read with VARIANT fields, then cleaned."""
    m = json_messages(spark, sf_dir)
    clean = M.clean_messages(m.select("thread_id", "content", "content_raw", "created_at", "event_id"), seq_col="event_id")
    return clean.select("thread_id", F.col("_seq").alias("event_id"), "msg_timestamp", "clean_content")


#: text of one JSON array file: several splits of the reader
ARRAY_BYTES = 256 << 20


@query("src_json_array")
def src_json_array(spark, sf_dir):
    """Messages from JSON array files, each of which many tasks read, then cleaned.

    A file is an array of events on one line, with nested objects and with
    braces, quotes and characters of several bytes inside strings.
    """
    from convlytics.session import scratch_path
    from convlytics.sources.json_source import read_json

    lines = spark.read.text(events_json_path(spark, sf_dir))
    odd = r',"meta":{"note":"}],{\\\" é日","parts":[{"x":[1,{}]},"]"]},"thread_id"'
    value = F.replace("value", F.lit(',"thread_id"'), F.lit(odd))

    def joined(batches):
        sign = "["
        for b in batches:
            texts = []
            for v in b.column(0).to_pylist():
                texts.append(sign + v)
                sign = ","
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if sign == "[" else "]"])], ["value"])

    path = scratch_path(spark, "events-array")
    # an array is one file, which one task writes as a stream: as many files as keep each near ARRAY_BYTES
    size = lines.agg(F.sum(F.octet_length(value))).first()[0] or 0
    lines.select(value.alias("value")).coalesce(1 + size // ARRAY_BYTES).mapInArrow(joined, "value string").write.option("lineSep", " ").text(path)
    schema = "event_id long, thread_id string, content variant, created_at variant, meta struct<note string, parts string>"
    m = read_json(spark, path, schema=schema, raw="content", multiline=True)
    kept = F.col("meta.note").startswith("}],{")
    clean = M.clean_messages(m.where(kept).select("thread_id", "content", "content_raw", "created_at", "event_id"), seq_col="event_id")
    return clean.select("thread_id", F.col("_seq").alias("event_id"), "msg_timestamp", "clean_content")


@query("src_json_collections")
def src_json_collections(spark, sf_dir):
    """Threads and messages from two JSON collections, checked and joined into the master table."""
    from convlytics.session import scratch_path
    from convlytics.sources.json_source import load_collections

    base = scratch_path(spark, "collections")
    t = T.threads(spark, sf_dir).select("thread_id", "status", F.struct(F.col("created_at").cast("string").alias("$date")).alias("created_at"))
    t.write.json(f"{base}/threads")
    m = T.messages(spark, sf_dir).select("thread_id", "content", F.col("created_at").cast("string").alias("created_at"))
    m.write.json(f"{base}/messages")
    threads, messages = load_collections(spark, f"{base}/threads", f"{base}/messages",
                                         threads_schema="thread_id string, status string, created_at variant")
    return M.build_master(threads, messages).select("thread_id", "status", "full_conversation", "msg_count")


@query("number_text")
def number_text(spark, sf_dir):
    """Numbers of very different sizes as message content."""
    from convlytics.functions.text import normalize_content

    e = T.read_table(spark, sf_dir, "events")
    scale = F.pow(F.lit(10.0), F.pmod(F.col("event_id"), F.lit(40)) - 15)
    c = e.select("event_id", F.when(F.pmod("event_id", F.lit(41)) == 7, F.lit(float("nan"))).otherwise(
        F.round("value", 2) * scale).alias("content"))
    text = normalize_content("content", "double")
    # SQL engines spell doubles in their own ways: compare the value and the form
    form = F.when(text == "", "missing").when(text.contains("e"), "power").otherwise("plain")
    return c.select("event_id", form.alias("form"), r6(F.log10(F.abs(F.nullif(text, F.lit("")).cast("double")) + 1e-30)).alias("magnitude"))


@query("normalize_content")
def normalize_content_q(spark, sf_dir):
    from convlytics.functions.text import normalize_content

    m = json_messages(spark, sf_dir)
    return m.select("event_id", normalize_content("content", "variant").alias("clean_content"))


@query("parse_dates")
def parse_dates_q(spark, sf_dir):
    from convlytics.functions.dates import parse_timestamp

    m = json_messages(spark, sf_dir)
    return m.select("event_id", parse_timestamp("created_at", "variant").alias("msg_timestamp"))


@query("master_roundtrip")
def master_roundtrip(spark, sf_dir):
    """Build, save and read back the master table (read-through store)."""
    from convlytics.session import scratch_path
    from convlytics.sources.stores import master_read_through

    path = scratch_path(spark, "master")
    m = master_read_through(spark, path, lambda: master_orders(spark, sf_dir), force_rebuild=True, persist=True)
    return m.select(
        "thread_id", "created_at", "status", "platform", "escalate_conversation",
        "full_conversation", "msg_count", "first_msg", "last_msg", r6("duration_minutes").alias("duration_minutes"),
    )


@query("metrics_csv_roundtrip")
def metrics_csv_roundtrip(spark, sf_dir):
    """Impact metrics written as CSV with a header and read back."""
    from convlytics.session import scratch_path
    from convlytics.sources.stores import load_metrics_csv, save_metrics_csv

    path = scratch_path(spark, "metrics-csv")
    save_metrics_csv(impact_metrics(spark, sf_dir), path)
    back = load_metrics_csv(spark, path)
    return back.select(*[F.col(c) if c == "estado_top" else r6(F.col(c).cast("double")).alias(c) for c in back.columns])


# --------------------------------------------------------------------------- profiling and validation


@query("profile_structure")
def profile_structure(spark, sf_dir):
    from convlytics.operators.profile import profile_structure as ps

    return ps(T.read_table(spark, sf_dir, "orders"))


@query("profile_missing")
def profile_missing(spark, sf_dir):
    """Missing values per column of the master table."""
    from convlytics.operators.profile import profile_missing as pm

    return pm(master_orders(spark, sf_dir), top_n=15)


@query("profile_uniques")
def profile_uniques(spark, sf_dir):
    from convlytics.operators.profile import profile_uniques as pu

    return pu(T.read_table(spark, sf_dir, "orders"), top_n=15)


@query("profile_uniques_missing")
def profile_uniques_missing(spark, sf_dir):
    """Distinct values per column of the threads; a missing value counts as one more."""
    from convlytics.operators.profile import profile_uniques as pu

    return pu(T.threads(spark, sf_dir), top_n=15, null_as_value=True)


@query("duplicate_table_rows")
def duplicate_table_rows(spark, sf_dir):
    """Whole rows that repeat, in a table that holds each line item and, of flag R, each twice."""
    from convlytics.operators.profile import duplicate_rows as dr

    li = T.read_table(spark, sf_dir, "lineitem")
    return dr(li.union(li.filter(F.col("l_returnflag") == "R"))).select(
        "n_rows", "n_duplicates", r6("pct_duplicates").alias("pct_duplicates"))


@query("duplicate_rows")
def duplicate_rows(spark, sf_dir):
    from convlytics.operators.profile import duplicate_rows as dr

    d = T.read_table(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars")
    return dr(d).select("n_rows", "n_duplicates", r6("pct_duplicates").alias("pct_duplicates"))


@query("validate_questions")
def validate_questions(spark, sf_dir):
    """User turns as questions, conversation id as session id; flags only."""
    from convlytics.operators.schema import validate_questions as vq

    q = T.messages_text(spark, sf_dir).filter(F.col("role") == "user").select(
        "thread_id", "seq", F.col("content").alias("question"), F.col("thread_id").alias("session_id")
    )
    q = q.withColumn("question_key", F.concat_ws(":", "thread_id", "seq"))
    return vq(q, id_col="question_key").select("thread_id", "seq", "question_ok", "session_ok", "valid")


@query("normalize_columns")
def normalize_columns_q(spark, sf_dir):
    """Customer columns under raw display names, normalised back to snake_case."""
    from convlytics.operators.schema import normalize_columns

    c = T.read_table(spark, sf_dir, "customer")
    raw = c.toDF(" C Custkey", "c-name", "C_NationKey!", "c  acct--bal", "C__Mkt Segment")
    return normalize_columns(raw).select("c_custkey", "c_name", "c_nationkey", "c_acct_bal", "c_mkt_segment")


# --------------------------------------------------------------------------- text and embeddings

EMBED_DIM = 64


def _embedder():
    from convlytics.functions.embedders import HashingEmbedder

    return HashingEmbedder(EMBED_DIM)


def doc_chunks(spark, sf_dir):
    from convlytics.operators.embed import chunk_texts

    return chunk_texts(T.read_table(spark, sf_dir, "documents"), "doc_id", "text")


def benchmark_cache(spark, sf_dir) -> str:
    """Embedding cache pre-filled with the chunks of the benchmark passages."""
    from convlytics.operators.embed import chunk_texts, fill_cache
    from convlytics.session import scratch_path

    key = ("bench_cache", sf_dir, id(spark))
    if key not in _DERIVED:
        path = scratch_path(spark, "embed-cache")
        emb = _embedder()
        fill_cache(spark, chunk_texts(T.read_table(spark, sf_dir, "benchmark"), "item_id", "text"), path, emb, emb.name)
        _DERIVED[key] = path
    return _DERIVED[key]


@query("hash_text")
def hash_text(spark, sf_dir):
    from convlytics.functions.text import sha256_hex

    return T.read_table(spark, sf_dir, "documents").select("doc_id", sha256_hex("text").alias("text_hash"))


@query("prepare_text")
def prepare_text(spark, sf_dir):
    """Training frame from the master table: first 1000 stripped chars, 0/1 target."""
    from convlytics.operators.ml import prepare_dataset

    return prepare_dataset(master_orders(spark, sf_dir)).select("thread_id", "text", "target")


@query("chunk_text")
def chunk_text(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("doc_id", "chunk_pos", "chunk")


@query("chunk_hashes")
def chunk_hashes(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("doc_id", "chunk_pos", "text_hash")


@query("distinct_chunks")
def distinct_chunks_q(spark, sf_dir):
    from convlytics.operators.embed import distinct_chunks

    return distinct_chunks(doc_chunks(spark, sf_dir))


@query("embed_cache_misses")
def embed_cache_misses(spark, sf_dir):
    """Distinct document chunks not yet in a cache filled from the benchmark passages."""
    from convlytics.operators.embed import cache_misses
    from convlytics.sources.stores import load_cache

    emb = _embedder()
    cache = load_cache(spark, benchmark_cache(spark, sf_dir), emb.name)
    return cache_misses(doc_chunks(spark, sf_dir), cache, emb.name)


@query("embed_cache_fill")
def embed_cache_fill(spark, sf_dir):
    """Fill a fresh cache with all document chunks, then again: the second pass adds nothing."""
    from convlytics.operators.embed import fill_cache
    from convlytics.session import scratch_path
    from convlytics.sources.stores import load_cache

    emb = _embedder()
    path = scratch_path(spark, "embed-cache-fill")
    chunks = doc_chunks(spark, sf_dir)
    fill_cache(spark, chunks, path, emb, emb.name)
    fill_cache(spark, chunks, path, emb, emb.name)
    return load_cache(spark, path, emb.name).select("model", "text_hash", F.size("embedding").alias("dim"))


@query("mean_pool")
def mean_pool_q(spark, sf_dir):
    """Mean vector per label of the embeddings table."""
    from convlytics.operators.embed import mean_pool

    v = T.read_table(spark, sf_dir, "embeddings")
    out = mean_pool(v.select("label", "embedding"), "label")
    return out.select("label", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("embed_documents")
def embed_documents_q(spark, sf_dir):
    """Documents -> chunk vectors (cached) -> one pooled vector per document, saved as Parquet."""
    from convlytics.operators.embed import embed_documents
    from convlytics.session import scratch_path

    from convlytics.functions.embedders import DigestEmbedder
    from convlytics.sources.stores import save_embeddings

    emb = DigestEmbedder()
    out = embed_documents(spark, T.read_table(spark, sf_dir, "documents"), "doc_id", "text",
                          scratch_path(spark, "embed-docs"), emb, emb.name)
    path = scratch_path(spark, "doc-embeddings")
    save_embeddings(out, path)
    # means of binary fractions lie on rounding boundaries; a nudge settles them
    return spark.read.parquet(path).select("doc_id", F.transform("embedding", lambda x: F.round(x + 1e-9, 6)).alias("embedding"))


@query("extract_json")
def extract_json(spark, sf_dir):
    """JSON object cut out of chatty text wrapped around each event's props."""
    from convlytics.functions.text import extract_json_block

    e = T.read_table(spark, sf_dir, "events")
    wrapped = F.concat(F.lit("answer:\n"), F.col("props"), F.lit(" end}"), F.col("event_type"))
    return e.select("event_id", extract_json_block(wrapped).alias("json_text"))


# --------------------------------------------------------------------------- semantic memory


def vectors(spark, sf_dir) -> DataFrame:
    return T.read_table(spark, sf_dir, "embeddings")


def qa_pairs(spark, sf_dir) -> DataFrame:
    """Each user turn with the assistant turn that follows it in the same conversation."""
    c = T.read_table(spark, sf_dir, "conversations")
    q = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return q.join(a, ["conv_id", "turn"], "left")


@query("l2_normalize")
def l2_normalize_q(spark, sf_dir):
    from convlytics.functions.vectors import l2_normalize

    v = vectors(spark, sf_dir)
    return v.select("vec_id", F.transform(l2_normalize("embedding"), lambda x: F.round(x, 6)).alias("embedding"))


def _knn_all(spark, sf_dir, k=3):
    from convlytics.operators.memory import knn_topk

    v = vectors(spark, sf_dir)
    return knn_topk(v.select(F.col("vec_id").alias("query_id"), "embedding"),
                    v.select(F.col("vec_id").alias("item_id"), "embedding"), k=k)


@query("knn_topk")
def knn_topk_q(spark, sf_dir):
    """Exact top-3 cosine neighbours of every vector among all vectors."""
    return _knn_all(spark, sf_dir, 3).select("query_id", "rank", "item_id", r6("score").alias("score"))


@query("knn_pruned")
def knn_pruned(spark, sf_dir):
    """The neighbours of knn_topk, by visits to the cells that may hold them."""
    from convlytics.operators.memory import knn_topk

    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("item_id"), "embedding")
    hits = knn_topk(v.withColumnRenamed("item_id", "query_id"), v, k=3, cells=32, pairs_per_task=200_000)
    return hits.select("query_id", "rank", "item_id", r6("score").alias("score"))


@query("knn_edges")
def knn_edges(spark, sf_dir):
    """Neighbours of every vector in small blocks; a zero and a NULL vector among them."""
    from convlytics.operators.memory import knn_topk

    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("item_id"), "embedding")
    zero = v.limit(1).select(F.lit(-1).cast("long").alias("item_id"), F.transform("embedding", lambda x: x * 0).alias("embedding"))
    null = zero.select(F.lit(-2).cast("long").alias("item_id"), F.lit(None).cast(v.schema["embedding"].dataType).alias("embedding"))
    corpus = v.unionByName(zero).unionByName(null)
    hits = knn_topk(corpus.withColumnRenamed("item_id", "query_id"), corpus, k=7, block_bytes=1 << 16, pairs_per_task=50_000, cells=0)
    return hits.select("query_id", "rank", "item_id", r6("score").alias("score"))


@query("memory_search")
def memory_search_q(spark, sf_dir):
    """Saved answers nearest to every question, from the store's texts, with their metadata."""
    return _searched(spark, sf_dir).select("query_id", "rank", "item_id", "text", F.col("metadata")["thread_id"].alias("thread_id"),
                                           r6("score").alias("score"))


def _searched(spark, sf_dir):
    from convlytics.functions.embedders import DigestEmbedder
    from convlytics.operators.embed import embed_rows
    from convlytics.operators.memory import memory_items, search_memory
    from convlytics.session import scratch_path
    from convlytics.sources.stores import append_memory, load_memory

    emb = DigestEmbedder()
    qa = qa_pairs(spark, sf_dir).withColumn("item", F.concat_ws(":", "conv_id", "turn"))
    items = memory_items(qa, "question", "answer", "item", "conv_id", "conv_id")
    path = scratch_path(spark, "memory")
    append_memory(embed_rows(items, emb, emb.name, text_col="text", key_col="item_id", carry=("text", "metadata")), path, "s1")
    return search_memory(user_questions(spark, sf_dir), load_memory(spark, path), emb, emb.name, k=3)


@query("prompt_with_context")
def prompt_with_context(spark, sf_dir):
    """System prompt of every question with the context that the memory gives for it."""
    from convlytics.operators.answers import system_prompts
    from convlytics.operators.memory import hits_context

    return system_prompts(user_questions(spark, sf_dir).select("question_id"), master_orders(spark, sf_dir),
                          hits_context(_searched(spark, sf_dir)))


@query("semantic_context")
def semantic_context_q(spark, sf_dir):
    """Retrieved context per query vector; item i's text is document i."""
    from convlytics.operators.memory import semantic_context

    docs = T.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return semantic_context(_knn_all(spark, sf_dir, 3), docs)


@query("memory_text")
def memory_text_q(spark, sf_dir):
    """Memory items from question/answer turn pairs; unanswered questions are skipped."""
    from convlytics.operators.memory import memory_items

    qa = qa_pairs(spark, sf_dir).withColumn("item", F.concat_ws(":", "conv_id", "turn"))
    return memory_items(qa, "question", "answer", "item", "conv_id", "conv_id").select(
        "item_id", "text", F.col("metadata")["thread_id"].alias("thread_id")
    )


@query("memory_append")
def memory_append_q(spark, sf_dir):
    """Embed memory items and save them twice: every save is kept, a repeated write of one is not."""
    from convlytics.operators.embed import embed_rows
    from convlytics.operators.memory import memory_items
    from convlytics.session import scratch_path
    from convlytics.sources.stores import append_memory, load_memory

    emb = _embedder()
    qa = qa_pairs(spark, sf_dir).withColumn("item", F.concat_ws(":", "conv_id", "turn"))
    items = memory_items(qa, "question", "answer", "item", "conv_id", "conv_id")
    vecs = embed_rows(items, emb, emb.name, text_col="text", key_col="item_id", carry=("text", "metadata"))
    path = scratch_path(spark, "memory")
    append_memory(vecs, path, "first")
    append_memory(load_memory(spark, path), path, "second")
    append_memory(load_memory(spark, path, ["second"]), path, "second")  # a batch written again
    return load_memory(spark, path).select("item_id", "save_id", "text", F.size("embedding").alias("dim"))


# --------------------------------------------------------------------------- evaluation


def scored_vectors(spark, sf_dir) -> DataFrame:
    """Fixed score column for evaluation: element 1 of each vector; target = label 3."""
    v = vectors(spark, sf_dir)
    return v.select(
        "vec_id",
        (F.col("label") == 3).cast("int").alias("target"),
        F.col("embedding")[1].cast("double").alias("score"),
    ).withColumn("prediction", (F.col("score") > 0).cast("int"))


@query("confusion_matrix")
def confusion_matrix_q(spark, sf_dir):
    from convlytics.operators.evaluate import confusion_matrix

    return confusion_matrix(scored_vectors(spark, sf_dir))


@query("classification_report")
def classification_report_q(spark, sf_dir):
    from convlytics.operators.evaluate import classification_report

    out = classification_report(scored_vectors(spark, sf_dir))
    return out.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@query("roc_auc")
def roc_auc_q(spark, sf_dir):
    from convlytics.operators.evaluate import roc_auc

    return roc_auc(scored_vectors(spark, sf_dir)).select(r6("roc_auc").alias("roc_auc"))


@query("average_precision")
def average_precision_q(spark, sf_dir):
    from convlytics.operators.evaluate import average_precision

    return average_precision(scored_vectors(spark, sf_dir)).select(r6("pr_auc").alias("pr_auc"))


@query("expected_cost")
def expected_cost_q(spark, sf_dir):
    from convlytics.operators.evaluate import expected_cost

    return expected_cost(scored_vectors(spark, sf_dir))


# --------------------------------------------------------------------------- model training


@query("stratified_split")
def stratified_split_q(spark, sf_dir):
    from convlytics.operators.ml import stratified_split

    v = scored_vectors(spark, sf_dir)
    return stratified_split(v, "vec_id", exact=False).select("vec_id", "target", "is_test")


@query("stratified_split_exact")
def stratified_split_exact_q(spark, sf_dir):
    """Per-class exact 20% test share by hash rank."""
    from convlytics.operators.ml import stratified_split

    v = scored_vectors(spark, sf_dir)
    return stratified_split(v, "vec_id", exact=True).select("vec_id", "target", "is_test")


def _train_on_vectors(spark, sf_dir):
    from convlytics.operators.ml import stratified_split, train_model
    from convlytics.session import scratch_path

    v = vectors(spark, sf_dir).select("vec_id", "embedding", (F.col("label") == 3).cast("int").alias("target"))
    path = scratch_path(spark, "train-split")
    stratified_split(v, "vec_id").write.parquet(path)  # read by the class counts, the fit and the scoring
    split = spark.read.parquet(path)
    model = train_model(split.filter(~F.col("is_test")))
    return model, split


@query("train_escalation_model")
def train_escalation_model(spark, sf_dir):
    """Balanced logistic regression on the training split; one row of facts about the fit."""
    from convlytics.operators.ml import score

    model, split = _train_on_vectors(spark, sf_dir)
    scored = score(model, split.filter(~F.col("is_test")))
    # at the optimum the weighted residuals balance: the intercept is not penalised
    w = F.sum(F.lit(1.0)).over(Window.partitionBy("target"))
    fit = scored.withColumn("r", (F.col("score") - F.col("target")) / w)
    return fit.agg(F.count(F.lit(1)).alias("n_train"), F.sum(F.col("target").cast("long")).alias("n_positive"),
                   (F.abs(F.sum("r")) < 1e-3).alias("balanced")).withColumn(
        "n_coefficients", F.lit(len(model.coefficients.toArray())))


@query("score_model")
def score_model(spark, sf_dir):
    from convlytics.operators.ml import score

    model, split = _train_on_vectors(spark, sf_dir)
    out = score(model, split.filter(F.col("is_test")))
    return out.select("vec_id", "target", (F.col("prediction") == (F.col("score") > 0.5).cast("int")).alias("consistent"),
                      F.col("score").between(0, 1).alias("in_range"))


@query("evaluate_model")
def evaluate_model(spark, sf_dir):
    from convlytics.operators.evaluate import evaluate
    from convlytics.operators.ml import score

    model, split = _train_on_vectors(spark, sf_dir)
    return evaluate(score(model, split.filter(F.col("is_test"))))


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Save the model under a version, load it back and score the test split."""
    from convlytics.operators.ml import score
    from convlytics.session import scratch_path
    from convlytics.sources.stores import load_model, save_model

    model, split = _train_on_vectors(spark, sf_dir)
    base = scratch_path(spark, "models")
    save_model(model, base, "v1")
    test = split.filter(F.col("is_test"))
    again = score(load_model(spark, base, "v1"), test).select("vec_id", F.col("score").alias("again"))
    return score(model, test).join(again, "vec_id").select("vec_id", "target", (F.col("score") == F.col("again")).alias("same_score"))


@query("escalation_training")
def escalation_training(spark, sf_dir):
    """Master table -> training text -> cached embeddings -> split -> train -> save -> evaluate."""
    from convlytics.operators.evaluate import evaluate
    from convlytics.operators.ml import train_escalation
    from convlytics.session import scratch_path
    from convlytics.sources.stores import save_model

    emb = _embedder()
    model, scored = train_escalation(master_orders(spark, sf_dir), emb, emb.name, scratch_path(spark, "embed-cache"),
                                     scratch_path(spark, "training"))
    save_model(model, scratch_path(spark, "models"), "v1")
    return evaluate(scored)


# --------------------------------------------------------------------------- agent answers


def event_answers(spark, sf_dir) -> DataFrame:
    """Answer texts of several shapes derived from each event.

    view -> full JSON answer, click -> JSON inside chatty text, error -> broken
    object, signup -> JSON without the expected keys, purchase -> JSON array.
    """
    e = T.read_table(spark, sf_dir, "events")
    et, k = F.col("event_type"), F.get_json_object("props", "$.k")
    answer = (
        F.when(et == "view", F.concat(
            F.lit('{"summary": "view '), k, F.lit('", "insights": ["k='), k,
            F.lit('"], "risks": [], "actions": ["check"], "metrics_used": ["value"]}')))
        .when(et == "click", F.lit('Claro: {"summary": "click", "insights": []} fin'))
        .when(et == "error", F.concat(F.lit("error {k: "), k, F.lit("}")))
        .when(et == "signup", F.col("props"))
        .otherwise(F.concat(F.lit("["), k, F.lit(", 2]")))
    )
    return e.select("event_id", "event_type", answer.alias("answer"), F.round("value", 2).alias("tiempo_s"))


@query("parse_json_lenient")
def parse_json_lenient_q(spark, sf_dir):
    from convlytics.functions.jsonudf import parse_json_lenient

    a = event_answers(spark, sf_dir)
    return a.select("event_id", parse_json_lenient(F.col("answer")).alias("analysis"))


@query("answer_quality")
def answer_quality(spark, sf_dir):
    from convlytics.operators.answers import score_answers

    out = score_answers(event_answers(spark, sf_dir), "answer")
    return out.select("event_id", "json_valido", "claves_presentes", "claves_faltantes", "score_estructura",
                      "insights_no_vacios", "actions_no_vacios")


@query("answer_quality_summary")
def answer_quality_summary_q(spark, sf_dir):
    from convlytics.operators.answers import answer_quality_summary, score_answers

    out = answer_quality_summary(score_answers(event_answers(spark, sf_dir), "answer"))
    return out.select(r6("score_promedio").alias("score_promedio"), "respuestas_validas", "total",
                      r6("tiempo_promedio").alias("tiempo_promedio"))


@query("route_normalize")
def route_normalize(spark, sf_dir):
    from convlytics.operators.answers import normalize_route

    e = T.read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    raw = (F.when(et == "error", F.lit("escalar")).when(et == "click", F.lit("tecnico"))
           .when(et == "purchase", F.lit("resumen")).when(et == "view", F.lit("Escalar")))
    return e.select("event_id", normalize_route(raw).alias("route"))


def user_questions(spark, sf_dir) -> DataFrame:
    c = T.read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"),
                    F.col("conv_id").cast("string").alias("thread_id"), F.col("text").alias("question"))


@query("prompt_table")
def prompt_table(spark, sf_dir):
    """System prompt for every user question: template + metrics summary of the master table."""
    from convlytics.operators.answers import system_prompts

    return system_prompts(user_questions(spark, sf_dir).select("question_id"), master_orders(spark, sf_dir))


@query("session_transcript")
def session_transcript_q(spark, sf_dir):
    from convlytics.operators.answers import session_transcript

    c = T.read_table(spark, sf_dir, "conversations")
    msgs = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("message_id"),
                    F.col("turn").alias("seq"), "role", "text")
    return session_transcript(msgs)


@query("batch_answer_eval")
def batch_answer_eval(spark, sf_dir):
    """Answer every user question with the offline answerer, time and score each answer."""
    from convlytics.functions.models import template_answerer
    from convlytics.operators.answers import evaluate_answers
    from convlytics.session import scratch_path

    out = evaluate_answers(user_questions(spark, sf_dir), master_orders(spark, sf_dir), template_answerer,
                           scratch_path(spark, "answers"))
    return out.withColumn("timed", F.col("tiempo_s") >= 0).drop("tiempo_s")


def _routed(spark, sf_dir):
    from convlytics.functions.models import keyword_router
    from convlytics.operators.answers import route_requests
    from convlytics.session import scratch_path

    questions = user_questions(spark, sf_dir)
    return route_requests(questions, master_orders(spark, sf_dir, questions), keyword_router,
                          scratch_path(spark, "routes"))


@query("route_conversations")
def route_conversations(spark, sf_dir):
    return _routed(spark, sf_dir).select("question_id", "thread_id", "route", "analysis")


@query("draft_by_route")
def draft_by_route_q(spark, sf_dir):
    from convlytics.functions.models import template_answerer
    from convlytics.operators.answers import draft_by_route
    from convlytics.session import scratch_path

    out = draft_by_route(_routed(spark, sf_dir), template_answerer, scratch_path(spark, "drafts"))
    return out.select("question_id", "route", "draft")


@query("answer_memory")
def answer_memory(spark, sf_dir):
    """Answers that are strict JSON become memory items (embedded, appended)."""
    from convlytics.functions.models import template_answerer
    from convlytics.operators.answers import evaluate_answers, strict_json_answers, system_prompts, call_model
    from convlytics.operators.embed import embed_rows
    from convlytics.operators.memory import memory_items
    from convlytics.session import scratch_path
    from convlytics.sources.stores import append_memory, load_memory

    emb = _embedder()
    qs = user_questions(spark, sf_dir)
    prompts = system_prompts(qs, master_orders(spark, sf_dir))
    staged = scratch_path(spark, "answers")
    call_model(prompts, template_answerer, "system_prompt", "question", "answer").drop("system_prompt") \
        .write.parquet(staged)
    answers = strict_json_answers(spark.read.parquet(staged))
    items = memory_items(answers, "question", "answer", "question_id", "thread_id", "thread_id")
    vecs = embed_rows(items, emb, emb.name, text_col="text", key_col="item_id", carry=("text", "metadata"))
    path = scratch_path(spark, "memory")
    append_memory(vecs, path)
    return load_memory(spark, path).select("item_id", "text", F.col("metadata")["thread_id"].alias("thread_id"))
