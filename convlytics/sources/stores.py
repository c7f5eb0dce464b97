"""Persistent stores: master table, metrics, embedding cache, memory, models.

Stores are Parquet datasets that are only ever appended to, so a path is
never overwritten while it is being read; a retried or repeated batch is
harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the cache and the memory are stores with modules of their own
from convlytics.sources.cache import append_cache, load_cache  # noqa: F401
from convlytics.sources.memory_store import append_memory, load_memory  # noqa: F401



def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("parquet").load(path).schema  # noqa: B018 - metadata only
        return True
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return False
        raise


def read_parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


# ----------------------------------------------------------------- master table


def save_master(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_master_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None


def master_read_through(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    force_rebuild: bool = False,
    persist: bool = True,
) -> DataFrame:
    """Return the saved master table, or build it (and save it when ``persist``).

    After a save the result is read back from the files, which also cuts the
    lineage of the build.
    """
    if not force_rebuild:
        cached = load_master_if_exists(spark, path)
        if cached is not None:
            return cached
    built = build()
    if not persist:
        return built
    save_master(built, path)
    return spark.read.parquet(path)


# ----------------------------------------------------------------- metrics


def save_metrics_csv(metrics: DataFrame, path_dir: str) -> None:
    """One-row metrics frame as CSV with a header (one file)."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path_dir)


def load_metrics_csv(spark: SparkSession, path_dir: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path_dir)


def save_embeddings(df: DataFrame, path_dir: str) -> None:
    df.write.mode("overwrite").parquet(path_dir)


# ----------------------------------------------------------------- models


def save_model(model, base_dir: str, version: str = "v1") -> str:
    path = f"{base_dir.rstrip('/')}/model_{version}"
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, base_dir: str, version: str = "v1"):
    from pyspark.ml.classification import LogisticRegressionModel

    path = f"{base_dir.rstrip('/')}/model_{version}"
    if not path_exists(spark, f"{path}/data"):
        raise FileNotFoundError(path)
    return LogisticRegressionModel.load(path)
