"""Master table: one row per conversation with its joined text and timings.

Plan (Spark-first):

* messages are cleaned with native expressions (no per-row Python);
* the per-thread aggregate is a hash aggregate on ``thread_id`` whose text
  column is an ordered ``listagg``;
* hot threads (more than ``hot_thread_rows`` messages) are found from a
  small sample (only sampled keys shuffle) and split into ranges of the sort
  order, so no single task sorts and concatenates a third of all messages;
  their texts are stitched in range order afterwards (ordered concatenation is
  associative).  Without a hot thread AQE drops that branch unread;
* cold and hot aggregates are joined to the threads apart, on ``thread_id``:
  the cold one is already hash-partitioned on the key, so its text is not
  shuffled again.  Messages and what comes of them are never broadcast: of a
  table with VARIANT columns Spark expects a small share of its true size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.errors import DataValidationError
from convlytics.functions.dates import duration_minutes, parse_timestamp
from convlytics.functions.text import normalize_content
from convlytics.operators.schema import normalize_columns, require_columns, require_rows

# Text separator of the joined conversation.
JOIN_SEP = " | "
AGG_COLUMNS = ("full_conversation", "msg_count", "first_msg", "last_msg")
# Hot-thread threshold: a thread with more messages than this is split.  The hot-key list is at most total_messages / threshold rows,
# which bounds what is broadcast.
HOT_THREAD_ROWS = 1_000_000
# Expected sample hits of a thread exactly at the threshold.
HOT_SAMPLE_HITS = 200


def _dtype(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def clean_messages(messages: DataFrame, seq_col: str | None = None) -> DataFrame:
    """thread_id, msg_timestamp, [seq], clean_content for each message."""
    m = normalize_columns(messages)
    require_columns(m, {"thread_id", "content"}, "messages")
    date_col = "created_at" if "created_at" in m.columns else ("createdat" if "createdat" in m.columns else None)
    ts = parse_timestamp(date_col, _dtype(m, date_col)) if date_col else F.lit(None).cast("timestamp")
    cols = [
        F.col("thread_id").cast("string").alias("thread_id"),
        ts.alias("msg_timestamp"),
        normalize_content("content", _dtype(m, "content"), "content_raw" if "content_raw" in m.columns else None)
        .alias("clean_content"),
    ]
    if seq_col:
        cols.append(F.col(seq_col).alias("_seq"))
    # groupby drops NULL keys in the reference model
    return m.select(*cols).filter(F.col("thread_id").isNotNull())


def _order_clause(has_seq: bool) -> str:
    keys = ["msg_timestamp ASC NULLS LAST"]
    if has_seq:
        keys.append("_seq ASC NULLS LAST")
    keys.append("clean_content ASC")
    return ", ".join(keys)


def _text_agg(has_seq: bool):
    return F.expr(
        f"listagg(nullif(clean_content, ''), '{JOIN_SEP}') WITHIN GROUP (ORDER BY {_order_clause(has_seq)})"
    )


def _single_level(clean: DataFrame, has_seq: bool) -> DataFrame:
    return clean.groupBy("thread_id").agg(
        F.coalesce(_text_agg(has_seq), F.lit("")).alias("full_conversation"),
        F.count(F.lit(1)).alias("msg_count"),
        F.min("msg_timestamp").alias("first_msg"),
        F.max("msg_timestamp").alias("last_msg"),
    )


def hot_threads(clean: DataFrame, hot_thread_rows: int, sample_rows: int = HOT_SAMPLE_HITS) -> DataFrame:
    """Thread ids that probably hold more than ``hot_thread_rows`` messages.

    Found from a Bernoulli sample so that only sampled keys are shuffled: a
    thread with ``hot_thread_rows`` messages is expected ``sample_rows`` times
    in the sample and is flagged from half of that.  The result has at most
    ``2 * #messages / hot_thread_rows`` rows (in expectation), a bound that
    does not grow with the number of threads, so it is safe to broadcast.
    Missing a hot thread only loses the split, never correctness.
    """
    fraction = min(1.0, sample_rows / float(hot_thread_rows))
    min_hits = max(1, math.ceil(fraction * hot_thread_rows / 2))
    return (
        clean.select("thread_id").sample(withReplacement=False, fraction=fraction, seed=17)
        .groupBy("thread_id").agg(F.count(F.lit(1)).alias("_hits"))
        .filter(F.col("_hits") >= F.lit(min_hits)).select("thread_id")
    )


def _hot_level(clean: DataFrame, has_seq: bool) -> DataFrame:
    """The aggregate of hot threads: row-balanced slices in parallel, then stitched.

    ``repartitionByRange`` on the thread and the sort keys cuts the rows into
    ranges of about equal size whatever the keys' types and values (a burst
    within a second, texts alike, a text ``seq``); ranges follow the order, so
    their texts are joined in range order.  The last step is one string per
    thread, which is the result itself (Spark's limit for it is 2 GB).
    """
    keys = [F.col("thread_id"), F.col("msg_timestamp").asc_nulls_last(),
            *([F.col("_seq").asc_nulls_last()] if has_seq else []), F.col("clean_content").asc()]
    sliced = clean.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id())
    parts = sliced.groupBy("thread_id", "_slice").agg(
        _text_agg(has_seq).alias("_part_text"),
        F.count(F.lit(1)).alias("_n"),
        F.min("msg_timestamp").alias("_first"),
        F.max("msg_timestamp").alias("_last"),
    )
    return parts.groupBy("thread_id").agg(
        F.coalesce(F.expr(f"listagg(_part_text, '{JOIN_SEP}') WITHIN GROUP (ORDER BY _slice)"), F.lit(""))
        .alias("full_conversation"),
        F.sum("_n").alias("msg_count"),
        F.min("_first").alias("first_msg"),
        F.max("_last").alias("last_msg"),
    )


def _only(df: DataFrame, thread_ids: DataFrame | None) -> DataFrame:
    """Rows of the requested threads; the semi-join stands below every aggregate of text."""
    if thread_ids is None:
        return df
    return df.join(thread_ids.select(F.col("thread_id").cast("string").alias("thread_id")).distinct(),
                   "thread_id", "left_semi")


def _aggregates(messages: DataFrame, seq_col: str | None, hot_thread_rows: int | None,
                thread_ids: DataFrame | None = None) -> list[DataFrame]:
    """Aggregates of the cold and of the hot threads, apart: each is partitioned on ``thread_id``."""
    clean = _only(clean_messages(messages, seq_col), thread_ids)
    has_seq = seq_col is not None
    if not hot_thread_rows:
        return [_single_level(clean, has_seq)]
    hot = hot_threads(clean, hot_thread_rows)
    return [_single_level(clean.join(F.broadcast(hot), "thread_id", "left_anti"), has_seq),
            _hot_level(clean.join(F.broadcast(hot), "thread_id", "left_semi"), has_seq)]


def conversation_aggregate(
    messages: DataFrame,
    seq_col: str | None = None,
    hot_thread_rows: int | None = HOT_THREAD_ROWS,
    thread_ids: DataFrame | None = None,
) -> DataFrame:
    """Per thread: ordered ``' | '`` text of non-blank messages, count, first/last time.

    Order inside a thread: timestamp ascending with missing times last, then
    ``seq_col`` (if given, of any orderable type), then the text itself so the
    result is deterministic.  ``msg_count`` counts blank messages too.
    ``thread_ids`` (optional, with a ``thread_id`` column) asks for some
    threads only; other messages are dropped before any text is shuffled.
    """
    parts = _aggregates(messages, seq_col, hot_thread_rows, thread_ids)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def prepare_threads(threads: DataFrame) -> DataFrame:
    t = normalize_columns(threads)
    require_columns(t, {"thread_id"}, "threads")
    clash = set(AGG_COLUMNS + ("duration_minutes",)) & set(t.columns)
    if clash:
        raise DataValidationError(f"thread columns clash with master columns: {sorted(clash)}")
    t = t.withColumn("thread_id", F.col("thread_id").cast("string"))
    if "created_at" in t.columns:
        t = t.withColumn("created_at", parse_timestamp("created_at", _dtype(t, "created_at")))
    return t


def build_master(
    threads: DataFrame,
    messages: DataFrame,
    seq_col: str | None = None,
    hot_thread_rows: int | None = HOT_THREAD_ROWS,
    thread_ids: DataFrame | None = None,
    strict: bool = True,
) -> DataFrame:
    """Threads inner-joined to their message aggregate, plus ``duration_minutes``.

    Duplicate thread rows are kept (each gets the aggregate); threads without
    messages are dropped -- see :func:`threads_without_messages`.  The cold
    aggregate meets the threads on the partitioning it already has, the hot
    one is joined apart, and the results are put together after the joins.

    ``strict`` (the default) raises :class:`DataValidationError` when there is
    no message to aggregate or no thread has one; for that it looks for one
    row of each at call time.  Without it such inputs give an empty table.
    """
    t = _only(prepare_threads(threads), thread_ids)
    if strict:
        require_rows(messages, "messages to aggregate")
        keys = clean_messages(messages).select("thread_id")
        require_rows(t.select("thread_id").join(keys.hint("merge"), "thread_id", "left_semi"), "master table")
    joined = [t.join(a.hint("merge"), "thread_id", "inner") for a in _aggregates(messages, seq_col, hot_thread_rows, thread_ids)]
    master = joined[0] if len(joined) == 1 else joined[0].unionByName(joined[1])
    return master.withColumn("duration_minutes", duration_minutes("first_msg", "last_msg"))


def threads_without_messages(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Thread rows the master join drops (anti join on the message keys)."""
    t = prepare_threads(threads)
    keys = clean_messages(messages).select("thread_id")
    return t.join(keys.hint("merge"), "thread_id", "left_anti")


def dropped_thread_count(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: threads before, threads with messages, threads dropped."""
    t = prepare_threads(threads)
    keys = clean_messages(messages).select("thread_id").distinct().withColumn("_has", F.lit(1))
    j = t.select("thread_id").join(keys.hint("merge"), "thread_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("threads_before"),
        F.count("_has").alias("threads_kept"),
        (F.count(F.lit(1)) - F.count("_has")).alias("threads_dropped"),
    )
