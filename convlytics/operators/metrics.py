"""Business metrics over the master table and the seven agent tool queries.

Every metric is a declarative aggregate: partial aggregation happens map
side, only per-key partials are shuffled, and top-n results use
``orderBy(...).limit(n)`` which plans as ``TakeOrderedAndProject`` (each
task keeps n rows).  Exact p90 uses the distributed quantile in
:mod:`convlytics.operators.ranking`; ``approx=True`` switches to
``percentile_approx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.errors import DataValidationError
from convlytics.functions.dates import month_key, parse_timestamp
from convlytics.functions.labels import coerce_label, volume_bucket, volume_bucket_dim
from convlytics.operators.ranking import combine_one_row, quantiles, quantiles_from_counts

FLAG = "escalate_conversation"


def _need(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise DataValidationError(f"missing columns: {missing}")


def top_values(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Most frequent non-NULL values: (value, count), count desc then value asc."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("value").asc())
        .limit(n)
    )


def _top_json(top: DataFrame, alias: str) -> DataFrame:
    """One row: JSON object ``{value: count}`` of ranked (value, count) rows, in rank order."""
    entries = F.array_sort(
        F.collect_list(F.struct(F.col("count"), F.col("value"))),
        lambda a, b: F.when(a["count"] > b["count"], -1)
        .when(a["count"] < b["count"], 1)
        .when(a["value"] < b["value"], -1)
        .when(a["value"] > b["value"], 1)
        .otherwise(0),
    )
    as_map = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["value"].cast("string"), e["count"])))
    return top.agg(F.to_json(as_map).alias(alias))


def top_values_json(df: DataFrame, col: str, n: int = 5, alias: str = "estado_top") -> DataFrame:
    """One row: JSON object ``{value: count}`` of the top-n values, in rank order."""
    return _top_json(top_values(df, col, n), alias)


def impact_metrics(master: DataFrame, approx: bool = False, strict: bool = True) -> DataFrame:
    """One row of impact metrics; a metric is present only if its source column is.

    tasa_escalamiento, duracion_promedio_min, duracion_p90_min,
    mensajes_promedio, mensajes_p90, estado_top (JSON of the top-5 statuses).

    One pass: the master rows are unpivoted to (metric, value) pairs and
    counted per distinct pair; means (sum of value x count / count), exact
    p90s and the status ranking are all derived from that small table.
    ``strict`` (the default) raises :class:`DataValidationError` on an empty
    input, for which it looks for one row at call time; without it an empty
    input yields NULL metrics.
    """
    if strict and master.isEmpty():
        raise DataValidationError("no rows to compute metrics on")
    cols = set(master.columns)
    numeric = [(c, src) for c, src in (("tasa_escalamiento", coerce_label(FLAG) if FLAG in cols else None),
                                      ("duration", F.col("duration_minutes") if "duration_minutes" in cols else None),
                                      ("msgs", F.col("msg_count") if "msg_count" in cols else None)) if src is not None]
    has_status = "status" in cols
    if not numeric and not has_status:
        raise DataValidationError("none of the metric columns is present")
    entries = [F.struct(F.lit(i).alias("_m"), src.cast("double").alias("_v"), F.lit(None).cast("string").alias("_s"))
               for i, (_, src) in enumerate(numeric)]
    status_id = len(numeric)
    if has_status:
        entries.append(F.struct(F.lit(status_id).alias("_m"), F.lit(None).cast("double").alias("_v"),
                                F.col("status").cast("string").alias("_s")))
    counts = (
        master.select(F.explode(F.array(*entries)).alias("_p")).select("_p._m", "_p._v", "_p._s")
        .filter(F.col("_v").isNotNull() | F.col("_s").isNotNull())
        .groupBy("_m", "_v", "_s").agg(F.count(F.lit(1)).alias("_n"))
    )
    ids = {name: i for i, (name, _) in enumerate(numeric)}
    frames = []
    if numeric:
        means = counts.filter(F.col("_m") < status_id).groupBy("_m").agg(
            (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("_mean"))
        names = {"tasa_escalamiento": "tasa_escalamiento", "duration": "duracion_promedio_min",
                 "msgs": "mensajes_promedio"}
        frames.append(means.agg(*[F.max(F.when(F.col("_m") == i, F.col("_mean"))).alias(names[n])
                                  for n, i in ids.items()]))
    specs = [(ids[n], 0.9, a) for n, a in (("duration", "duracion_p90_min"), ("msgs", "mensajes_p90")) if n in ids]
    if specs and approx:
        frames.append(quantiles(master, [(c, 0.9, a) for c, a in (("duration_minutes", "duracion_p90_min"),
                                                                   ("msg_count", "mensajes_p90")) if c in cols], True))
    elif specs:
        frames.append(quantiles_from_counts(counts.select("_m", "_v", "_n"), specs))
    if has_status:
        top = (counts.filter(F.col("_m") == status_id).select(F.col("_s").alias("value"), F.col("_n").alias("count"))
               .orderBy(F.col("count").desc(), F.col("value").asc()).limit(5))
        frames.append(_top_json(top, "estado_top"))
    order = ["tasa_escalamiento", "duracion_promedio_min", "duracion_p90_min", "mensajes_promedio", "mensajes_p90",
             "estado_top"]
    out = combine_one_row(frames)
    return out.select(*[c for c in order if c in out.columns])


def escalation_by_category(master: DataFrame, col: str = "status", top_n: int = 8) -> DataFrame:
    """Escalation rate per category value (NULL category dropped), highest first."""
    _need(master, col, FLAG)
    return (
        master.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.avg(coerce_label(FLAG).cast("double")).alias("escalation_rate"))
        .orderBy(F.col("escalation_rate").desc(), F.col(col).asc())
        .limit(top_n)
    )


def escalation_by_volume(master: DataFrame) -> DataFrame:
    """Escalation rate per message-volume bucket; all 7 buckets, empty ones NULL."""
    _need(master, "msg_count", FLAG)
    rates = (
        master.select(volume_bucket("msg_count").alias("msg_bucket"), coerce_label(FLAG).alias("_flag"))
        .filter(F.col("msg_bucket").isNotNull())
        .groupBy("msg_bucket")
        .agg(F.avg(F.col("_flag").cast("double")).alias("escalation_rate"), F.count(F.lit(1)).alias("n_threads"))
    )
    dim = volume_bucket_dim(master.sparkSession)
    # 7-row dimension on the left, at most 7 aggregated rows on the right
    return (
        dim.join(F.broadcast(rates), "msg_bucket", "left")
        .select("msg_bucket", "bucket_order", "escalation_rate", F.coalesce("n_threads", F.lit(0)).alias("n_threads"))
        .orderBy("bucket_order")
    )


def monthly_trend(master: DataFrame, date_col: str = "created_at") -> DataFrame:
    """Escalation rate per 'yyyy-MM' month of ``date_col``, month ascending."""
    _need(master, date_col, FLAG)
    ts = parse_timestamp(date_col, master.schema[date_col].dataType.simpleString())
    return (
        master.select(ts.alias("_ts"), coerce_label(FLAG).alias("_flag"))
        .filter(F.col("_ts").isNotNull())
        .groupBy(month_key("_ts").alias("month"))
        .agg(F.avg(F.col("_flag").cast("double")).alias("escalation_rate"))
        .orderBy("month")
    )


def operating_times(master: DataFrame, approx: bool = False) -> DataFrame:
    """Mean and p90 of duration (minutes) and of message count (one value-count pass)."""
    _need(master, "duration_minutes", "msg_count")
    out = impact_metrics(master.select("duration_minutes", "msg_count"), approx=approx)
    return out.select("duracion_promedio_min", "duracion_p90_min", "mensajes_promedio", "mensajes_p90")


def context_summary(master: DataFrame) -> DataFrame:
    """One row ``summary``: up to three formatted lines (rate .3f, duration .2f, messages .2f)."""
    cols = set(master.columns)
    aggs, lines = [], []
    if FLAG in cols:
        aggs.append(F.avg(coerce_label(FLAG).cast("double")).alias("_rate"))
        lines.append(F.format_string("Tasa de escalamiento: %.3f", F.col("_rate")))
    if "duration_minutes" in cols:
        aggs.append(F.avg(F.col("duration_minutes").cast("double")).alias("_dur"))
        lines.append(F.format_string("Duracion promedio (min): %.2f", F.col("_dur")))
    if "msg_count" in cols:
        aggs.append(F.avg(F.col("msg_count").cast("double")).alias("_msgs"))
        lines.append(F.format_string("Mensajes promedio: %.2f", F.col("_msgs")))
    if not aggs:
        return master.sparkSession.range(1).select(F.lit("").alias("summary"))
    return master.agg(*aggs).select(F.concat_ws("\n", *lines).alias("summary"))


def top_threads(master: DataFrame, by: str, n: int = 5) -> DataFrame:
    """Top-n threads by ``by`` descending, ties by thread_id."""
    _need(master, "thread_id", by)
    return master.select("thread_id", by).orderBy(F.col(by).desc(), F.col("thread_id").asc()).limit(n)


def top_threads_by_messages(master: DataFrame, n: int = 5) -> DataFrame:
    return top_threads(master, "msg_count", n)


def top_threads_by_duration(master: DataFrame, n: int = 5) -> DataFrame:
    return top_threads(master, "duration_minutes", n)


def conversation_lookup(master: DataFrame, thread_ids: DataFrame) -> DataFrame:
    """Conversation text for each requested thread id (first master row per id).

    ``thread_ids`` has a ``thread_id`` column; ids are compared as text.  An
    equi-join answers a whole batch of lookups in one pass; ids with no match
    produce no row.
    """
    _need(master, "thread_id", "full_conversation")
    req = thread_ids.select(F.col("thread_id").cast("string").alias("thread_id")).distinct()
    first = master.groupBy(F.col("thread_id").cast("string").alias("thread_id")).agg(
        F.min("full_conversation").alias("full_conversation")
    )
    return req.join(first, "thread_id", "inner")


def conversation_text_raw(messages: DataFrame, thread_ids: DataFrame, seq_col: str | None = None,
                          hot_rows: int | None = None) -> DataFrame:
    """Fallback lookup on raw messages: newline join of the first text column.

    The text column is the first of content, message_text, text, body
    (missing text reads 'None').  Order inside a thread: ``seq_col`` if given,
    then the text.  Hot threads are split as in the master table.
    """
    from convlytics.operators.master import HOT_THREAD_ROWS
    from convlytics.operators.textagg import ordered_concat

    text_col = next((c for c in ("content", "message_text", "text", "body") if c in messages.columns), None)
    if text_col is None:
        raise DataValidationError("no text column among content, message_text, text, body")
    req = thread_ids.select(F.col("thread_id").cast("string").alias("thread_id")).distinct()
    m = messages.select(
        F.col("thread_id").cast("string").alias("thread_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("None")).alias("_txt"),
        *([F.col(seq_col)] if seq_col else []),
    ).join(req, "thread_id", "left_semi")
    return ordered_concat(m, "thread_id", "_txt", [seq_col] if seq_col else [], "\n", "conversation",
                          hot_rows if hot_rows is not None else HOT_THREAD_ROWS)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """The one metrics row as a JSON object string ``metrics_json``."""
    return metrics.select(F.to_json(F.struct(*[F.col(c) for c in metrics.columns])).alias("metrics_json"))
