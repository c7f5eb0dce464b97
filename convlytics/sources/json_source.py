"""JSON collections of threads and messages.

Messages are read with an explicit schema whose ``content`` and date fields
are VARIANT, so lists, objects, numbers and ``{"$date": ...}`` wrappers all
survive the read without a schema-inference pass.  JSON Lines files
(``multiline=False``) and JSON array files (``multiline=True``, see
``json_array``) both split across tasks, and both are parsed once.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlytics.errors import DataValidationError
from convlytics.session import scratch_path
from convlytics.sources.json_array import array_records

# Default message schema.  Files that spell the date field ``createdAt`` need
# a schema naming it that way; it normalises to ``createdat``, the fallback
# date column of the master table.
MESSAGES_SCHEMA = "thread_id string, content variant, created_at variant"


def _reading(path: str, read):
    try:
        return read()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(path) from exc
        raise DataValidationError(f"malformed JSON at {path}: {exc}") from exc


def json_records(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """``value``: the JSON text of each record, from lines or from arrays."""
    if multiline:
        return _reading(path, lambda: array_records(spark, path))
    return _reading(path, lambda: spark.read.text(path)).filter(F.trim("value") != "")


def infer_schema(records: DataFrame) -> str:
    """Schema of the records' objects: one aggregate over all of them."""
    try:
        kind = records.agg(F.schema_of_variant_agg(F.parse_json("value")).alias("s")).first()["s"]
    except (PySparkException, Py4JJavaError) as exc:
        raise DataValidationError(f"malformed JSON: {str(exc)[:500]}") from exc
    if not kind.startswith("OBJECT<"):
        raise DataValidationError("there are no records, or they are not objects")
    kind = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", kind)
    return re.sub(r"\bVOID\b", "STRING", kind).replace("OBJECT<", "STRUCT<")


def read_json(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = False,
              raw: str | None = None) -> DataFrame:
    """A JSON collection; malformed input fails the job that meets it.

    ``raw`` names a field whose own JSON text is kept in ``<field>_raw`` (a
    VARIANT holds an object's keys sorted).  Without a schema one more pass
    infers it; JSON Lines are then left to Spark's reader.
    """
    if not multiline and not (raw and schema):
        reader = spark.read.option("mode", "FAILFAST")
        return _reading(path, lambda: (reader.schema(schema) if schema else reader).json(path))
    records = json_records(spark, path, multiline)
    row = F.from_json("value", schema or infer_schema(records), {"mode": "FAILFAST"}).alias("_row")
    if not raw:
        return records.select(row).select("_row.*")
    return records.select(row, F.get_json_object("value", f"$.{raw}").alias(f"{raw}_raw")).select("_row.*", f"{raw}_raw")


def _checked(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """The collection, parsed once into a table of the shared folder; what cannot be parsed raises here."""
    staged = scratch_path(spark, "collection")
    try:
        df.write.parquet(staged)
    except (PySparkException, Py4JJavaError) as exc:
        raise DataValidationError(f"malformed JSON at {path}: {str(exc)[:500]}") from exc
    return spark.read.schema(df.schema).parquet(staged)


def load_collections(
    spark: SparkSession,
    threads_path: str,
    messages_path: str,
    multiline: bool = False,
    threads_schema: str | None = None,
    messages_schema: str | None = MESSAGES_SCHEMA,
    check_empty: bool = True,
    validate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(threads, messages) DataFrames; missing file -> FileNotFoundError.

    ``validate`` parses both files at call time, into tables that later reads
    use instead, and raises :class:`DataValidationError` on a malformed record;
    without it the job that meets one fails.  ``check_empty`` looks for one row
    of each and raises the same when either is empty.
    """
    t = read_json(spark, threads_path, threads_schema, multiline)
    m = read_json(spark, messages_path, messages_schema, multiline, raw="content")
    if validate:
        t, m = _checked(spark, t, threads_path), _checked(spark, m, messages_path)
    if check_empty and (t.isEmpty() or m.isEmpty()):
        raise DataValidationError("threads or messages are empty")
    return t, m
