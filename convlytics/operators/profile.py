"""Data-quality profiling: structure, missing values, distinct values, duplicates.

All profiles are one or two passes over the data.  Distinct counts unpivot
to ``(column, value)`` pairs first, so the plan is one shuffle keyed by the
pair instead of one ``count(DISTINCT)`` expansion per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _as_text(df: DataFrame, name: str):
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def _digest(value):
    """SHA-256 of a text: what is shuffled is 32 bytes, however long the value."""
    return F.unhex(F.sha2(value, 256))


def _columns_dim(df: DataFrame):
    """(column, position, dtype) rows from the schema (metadata, not data)."""
    rows = [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, dtype string")


def profile_structure(df: DataFrame) -> DataFrame:
    """Per column: position, dtype, non-NULL count and total rows (one pass)."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns)]
    counts = df.agg(*aggs)
    long = counts.select(
        F.col("_n").alias("n_rows"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"_c{i}").alias("non_null"))
                            for i in range(len(df.columns))])).alias("_s"),
    ).select("n_rows", "_s.position", "_s.non_null")
    return _columns_dim(df).join(F.broadcast(long), "position").select(
        "column", "position", "dtype", "non_null", "n_rows"
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """Per column: number of missing values (NULL, and NaN for floating columns)."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        miss = c.isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(c)
        aggs.append(F.sum(miss.cast("long")).alias(f"_m{i}"))
    counts = df.agg(*aggs)
    long = counts.select(
        F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"_m{i}").alias("missing_count"))
                            for i, f in enumerate(df.schema.fields)])).alias("_s")
    ).select("_s.column", F.coalesce("_s.missing_count", F.lit(0)).alias("missing_count"))
    return long


def profile_missing(df: DataFrame, top_n: int = 15) -> DataFrame:
    """Columns with missing values, most first (ties by name), top-n."""
    return (
        missing_counts(df).filter(F.col("missing_count") > 0)
        .orderBy(F.col("missing_count").desc(), F.col("column").asc())
        .limit(top_n)
    )


def distinct_counts(df: DataFrame, approx: bool = False, null_as_value: bool = False) -> DataFrame:
    """Per column: number of distinct values, compared as text.

    ``null_as_value=True`` counts missing as one more value (the
    stringified-object rule of the reference profile); default skips NULL as
    SQL does.  ``approx`` uses HyperLogLog++ per column in one pass instead
    of an exact shuffle of the distinct pairs.
    """
    if approx:
        counts = df.agg(*[F.approx_count_distinct(_as_text(df, c)).alias(f"_u{i}") for i, c in enumerate(df.columns)])
        long = counts.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_u{i}").alias("unique_values"))
                                for i, c in enumerate(df.columns)])).alias("_s")
        ).select("_s.column", "_s.unique_values")
        return long
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("column"), _digest(_as_text(df, c)).alias("value"))
                            for i, c in enumerate(df.columns)])).alias("_p")
    ).select("_p.column", "_p.value")
    if null_as_value:
        pairs = pairs.withColumn("value", F.coalesce(F.col("value"), _digest(F.lit("None"))))
    else:
        pairs = pairs.filter(F.col("value").isNotNull())
    per_col = pairs.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    return (
        _columns_dim(df).join(per_col.withColumnRenamed("column", "position"), "position", "left")
        .select("column", F.coalesce("unique_values", F.lit(0)).alias("unique_values"))
    )


def profile_uniques(df: DataFrame, top_n: int = 15, approx: bool = False, null_as_value: bool = False) -> DataFrame:
    """Columns by number of distinct values, most first (ties by name), top-n."""
    return (
        distinct_counts(df, approx=approx, null_as_value=null_as_value)
        .orderBy(F.col("unique_values").desc(), F.col("column").asc())
        .limit(top_n)
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_duplicates (rows equal to an earlier row), pct_duplicates.

    Missing values compare equal.  Values compare as text (nested and VARIANT
    ones as JSON); a 256-bit digest of the row is what is shuffled.
    """
    # each cell is preceded by its length, so that no two rows run together alike
    cells = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
             for t in (_as_text(df, c) for c in df.columns)]
    per_row = df.select(_digest(F.concat_ws(",", *cells)).alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_k"))
    out = per_row.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("n_rows"),
                      F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("n_duplicates"))
    return out.select(
        "n_rows", "n_duplicates",
        F.when(F.col("n_rows") > 0, F.col("n_duplicates") * 100.0 / F.col("n_rows")).otherwise(F.lit(0.0))
        .alias("pct_duplicates"),
    )


def shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` rows (the head of the structure report)."""
    return df.limit(n)
