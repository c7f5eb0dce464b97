"""Saved answers: append-only, each save seen as a whole or not at all.

A save writes its rows to a folder of their own, ``<path>/data/<attempt>``, and
then one row to ``<path>/commits``, which names the save and the folder.
Readers take the folders that the commits name, the first one of each save: a
save that was cut off, or one that was written again after a failure, is
passed over when files are listed, and no row is compared with another.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY_SCHEMA = (
    "item_id string, save_id string, text string, metadata map<string,string>, embedding array<float>"
)
COMMIT_SCHEMA = "save_id string, attempt string, committed_ns long"


def commits(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder that counts for each save: that of its first commit."""
    from convlytics.sources.stores import read_parquet_or_empty

    rows = read_parquet_or_empty(spark, f"{path}/commits", COMMIT_SCHEMA)
    first = rows.groupBy("save_id").agg(F.min(F.struct("committed_ns", "attempt"))["attempt"].alias("attempt"))
    return {r["save_id"]: r["attempt"] for r in first.collect()}


def load_memory(spark: SparkSession, path: str, saves: list[str] | None = None) -> DataFrame:
    """Every committed save, or those named: a snapshot that later saves do not change.

    The driver holds one folder name a save.
    """
    found = commits(spark, path)
    folders = [f"{path}/data/{a}" for s, a in sorted(found.items()) if saves is None or s in saves]
    return spark.read.schema(MEMORY_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], MEMORY_SCHEMA)


def append_memory(items: DataFrame, path: str, save_id: str | None = None) -> str:
    """Append one save; returns its ``save_id`` (a new one unless given).

    A save that is committed already is left as it is and nothing is written.
    An item that stands in the batch several times is saved once.
    """
    spark = items.sparkSession
    if save_id is not None and save_id in commits(spark, path):
        return save_id
    save_id, attempt = save_id or uuid.uuid4().hex, uuid.uuid4().hex
    rows = items.select(
        "item_id", F.lit(save_id).alias("save_id"), "text", F.col("metadata").cast("map<string,string>").alias("metadata"),
        F.col("embedding").cast("array<float>").alias("embedding"))
    rows.dropDuplicates(["item_id"]).write.parquet(f"{path}/data/{attempt}")
    commit = spark.createDataFrame([(save_id, attempt, time.time_ns())], COMMIT_SCHEMA)
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return save_id
