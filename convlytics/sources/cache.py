"""Embedding cache: vectors by model and hash of the text, laid out for joins.

The rows lie in buckets of ``text_hash``, sorted by model and hash, each file
with a Bloom filter of its hashes.  Joins and aggregates on the hash read the
cache as it is, without an exchange; a lookup of a few hashes reads only their
buckets, and of those only row groups whose statistics and filters fit.

``<path>/layout`` names the generations of the cache and their numbers of
buckets; the largest generation counts, its files are ``<path>/data-<n>``.
Appends go there, one file for each bucket that gets rows.  ``compact_cache``
writes a new generation, each key once and one file a bucket, and names it in
the layout when it is complete, so readers see the old one or the new one.
Run it apart from appends.  The last generation but one stays for readers
that began with it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT_SCHEMA = "generation int, buckets int"
COLUMNS = ("model", "text_hash", "embedding", "batch_id")
_TABLE_SCHEMA = "model string, text_hash string, embedding array<float>, batch_id string"
#: buckets at most; without a number a cache has as many as the session has shuffle partitions
MOST_BUCKETS = 4096


def _layout(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(generation, buckets) that count, or None where there is no cache."""
    from convlytics.sources.stores import read_parquet_or_empty

    rows = read_parquet_or_empty(spark, f"{path}/layout", LAYOUT_SCHEMA).orderBy(F.desc("generation"), "buckets").limit(1).collect()
    return (rows[0]["generation"], rows[0]["buckets"]) if rows else None


def _name_layout(spark: SparkSession, path: str, generation: int, buckets: int) -> None:
    spark.createDataFrame([(generation, buckets)], LAYOUT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/layout")


def _table(spark: SparkSession, path: str, generation: int, buckets: int) -> str:
    """The session's name for the files of one generation."""
    place = f"{path}/data-{generation}"
    name = f"convlytics_cache_{hashlib.sha256(place.encode()).hexdigest()[:16]}"
    quoted = place.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_TABLE_SCHEMA}) USING parquet "
              "OPTIONS ('parquet.bloom.filter.enabled#text_hash' 'true', 'parquet.bloom.filter.adaptive.enabled' 'true') "
              f"CLUSTERED BY (text_hash) SORTED BY (model, text_hash) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    spark.catalog.refreshTable(name)  # other sessions may have appended
    return name


def cache_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the cache as they were appended."""
    found = _layout(spark, path)
    if found is None:
        return spark.createDataFrame([], _TABLE_SCHEMA)
    return spark.table(_table(spark, path, *found))


def load_cache(spark: SparkSession, path: str, model: str | None = None, hashes: list[str] | None = None) -> DataFrame:
    """Cache rows ``(model, text_hash, embedding)``, one per key.

    With a model they are de-duplicated on ``text_hash`` alone, which the
    buckets need no exchange for.  ``hashes`` keeps the rows of these only,
    and their buckets are all that is read.
    """
    c = cache_rows(spark, path).drop("batch_id")
    if hashes is not None:
        c = c.where(F.col("text_hash").isin(hashes)) if hashes else c.where(F.lit(False))
    if model is not None:
        return c.where(F.col("model") == model).dropDuplicates(["text_hash"])
    return c.dropDuplicates(["model", "text_hash"])


def _write(rows: DataFrame, name: str, buckets: int) -> None:
    # dealt as the table's buckets are: a task writes one file
    (rows.select("model", "text_hash", F.col("embedding").cast("array<float>").alias("embedding"), "batch_id")
     .repartition(buckets, "text_hash").sortWithinPartitions("model", "text_hash").write.insertInto(name))


def append_cache(new_rows: DataFrame, path: str, buckets: int | None = None) -> None:
    """Append rows; ``buckets`` counts where the cache is new."""
    spark = new_rows.sparkSession
    found = _layout(spark, path)
    if found is None:
        n = buckets or min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        _name_layout(spark, path, 0, n)
        found = 0, n
    if "batch_id" not in new_rows.columns:
        new_rows = new_rows.withColumn("batch_id", F.lit(None).cast("string"))
    _write(new_rows, _table(spark, path, *found), found[1])


def compact_cache(spark: SparkSession, path: str, buckets: int | None = None) -> None:
    """Rewrite the cache with each key once and one file a bucket, in ``buckets`` if given."""
    found = _layout(spark, path)
    if found is None:
        return
    generation, n = found[0] + 1, buckets or found[1]
    rows = spark.table(_table(spark, path, *found))
    # an attempt that failed may have left files of this generation
    _remove(spark, f"{path}/data-{generation}")
    _write(rows.dropDuplicates(["text_hash", "model"]), _table(spark, path, generation, n), n)
    _name_layout(spark, path, generation, n)
    _remove(spark, f"{path}/data-{generation - 2}")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
