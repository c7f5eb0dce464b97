"""Driver test tables mapped onto the conversation data model.

``orders`` play conversation headers (threads), ``lineitem`` rows play
messages, ``conversations`` are messages with real text, ``events`` are
per-user messages with JSON bodies.  Reads are plain Parquet scans so column
pruning and filter pushdown reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: thread_id, created_at, status, platform, escalate_conversation."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("thread_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("platform"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("int"))
        .otherwise(F.lit(0))
        .alias("escalate_conversation"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: thread_id, created_at, content ('' for flag N)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("thread_id"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_returnflag") == "N", F.lit(""))
        .otherwise(F.concat_ws(" ", F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber").cast("string")))
        .alias("content"),
    )


def messages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages without timestamps: thread_id, seq, role, content."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("thread_id"),
        F.col("turn").alias("seq"),
        F.col("role"),
        F.col("text").alias("content"),
    )


def messages_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as per-user messages: thread_id, created_at, event_type, content (JSON text)."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("thread_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type"),
        F.col("props").alias("content"),
    )
