"""Ordered text concatenation per key that survives hot keys.

``listagg ... WITHIN GROUP (ORDER BY ...)`` holds a whole group in one task.
For keys that hold a large share of the rows (found from a sample, see
:func:`convlytics.operators.master.hot_threads`), rows are first grouped by
(key, slice), a slice being a range of the sort order, so the slices are
sorted and concatenated in parallel; the slice texts are then stitched in
slice order.  Ordered concatenation is associative, so both paths
give the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def ordered_concat(
    df: DataFrame,
    key: str,
    text: str,
    order: list[str],
    sep: str,
    out_col: str,
    hot_rows: int | None,
    count_col: str | None = None,
) -> DataFrame:
    """(key, out_col[, count_col]): texts joined by ``sep`` in ``order`` (ASC NULLS LAST), then text.

    NULL texts are skipped; a key whose texts are all NULL gets NULL.
    """
    from convlytics.operators.master import hot_threads

    keys = [*order, text]
    order_sql = ", ".join(f"`{c}` ASC NULLS LAST" for c in keys)
    agg_sql = f"listagg(`{text}`, '{sep}') WITHIN GROUP (ORDER BY {order_sql})"
    sep_escaped = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    agg_sql = agg_sql.replace(f"'{sep}'", f"'{sep_escaped}'")

    def single(d: DataFrame) -> DataFrame:
        aggs = [F.expr(agg_sql).alias(out_col)]
        if count_col:
            aggs.append(F.count(F.lit(1)).alias(count_col))
        return d.groupBy(key).agg(*aggs)

    if not hot_rows:
        return single(df)
    hot = hot_threads(df.withColumnRenamed(key, "thread_id"), hot_rows).withColumnRenamed("thread_id", key)
    tagged = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cold = single(tagged.filter(F.col("_hot").isNull()).drop("_hot"))
    # ranges of the sort order of about equal size, whatever the keys' types
    ranges = [F.col(key), *[F.col(c).asc_nulls_last() for c in keys]]
    sliced = (tagged.filter(F.col("_hot")).drop("_hot").repartitionByRange(*ranges)
              .withColumn("_slice", F.spark_partition_id()))
    part_aggs = [F.expr(agg_sql).alias("_part")]
    if count_col:
        part_aggs.append(F.count(F.lit(1)).alias("_n"))
    parts = sliced.groupBy(key, "_slice").agg(*part_aggs)
    stitched = F.expr(f"listagg(_part, '{sep_escaped}') WITHIN GROUP (ORDER BY _slice)")
    final = [stitched.alias(out_col)]
    if count_col:
        final.append(F.sum("_n").alias(count_col))
    heavy = parts.groupBy(key).agg(*final)
    return cold.unionByName(heavy)
