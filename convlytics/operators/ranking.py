"""Global running sums and exact quantiles without a single-partition window.

A running sum in a global order is the building block of exact quantiles,
ROC-AUC and average precision.  ``Window.orderBy`` without a partition key
would pull every row into one task, so instead:

1. split points are taken with ``percentile_approx`` (one row, at most
   ``n_buckets`` values -- a proven bound, safe to broadcast); ``n_buckets``
   defaults to the shuffle partition count, so buckets stay task-sized;
2. each row gets a bucket id that is monotone in the order key: a binary
   search (O(log n_buckets)) against the broadcast split array, JVM-side;
3. the running sum inside a bucket is a window partitioned by bucket (many
   tasks in parallel);
4. per-bucket totals (at most ``n_buckets`` rows) give exclusive offsets,
   broadcast back and added.

The input should hold one row per distinct order value (pre-aggregate
counts first), so a hot value is one row, not a third of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BUCKETS = 64


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame to every row of ``df``.

    The row enters as one scalar subquery (evaluated once, value inlined), so
    there is no join and ``df`` is not shuffled.
    """
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("_row")).scalar()
    return df.select("*", *[packed[c].alias(c) for c in one_row.columns])


def bucket_of(x, splits, max_splits: int):
    """Number of values in the ascending array ``splits`` that are < ``x``.

    Binary search written as a higher-order ``aggregate`` over
    ceil(log2(max_splits + 1)) steps, so it is O(log P) per row and JVM-side.
    """
    steps = max(1, math.ceil(math.log2(max_splits + 1)))

    def step(acc, i):
        width = F.pow(F.lit(2), F.lit(steps - 1) - i).cast("int")
        probe = acc + width
        return F.when((probe <= F.size(splits)) & (F.element_at(splits, probe) < x), probe).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0), step)


def default_buckets(df: DataFrame) -> int:
    """At least 64, else the session's shuffle partition count (cluster-sized)."""
    try:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        parts = DEFAULT_BUCKETS
    return max(DEFAULT_BUCKETS, parts)


def _bucket_ids(df: DataFrame, order_col: str, n_buckets: int, by: list[str]) -> DataFrame:
    qs = [i / n_buckets for i in range(1, n_buckets)]
    pa = F.percentile_approx(F.col(order_col).cast("double"), F.lit(qs), F.lit(max(10000, 4 * n_buckets)))
    splits = F.array_sort(F.array_distinct(pa)).alias("_splits")
    if by:
        # one row per group (a handful of metrics): bounded, broadcast
        with_splits = df.join(F.broadcast(df.groupBy(*by).agg(splits)), by, "inner")
    else:
        with_splits = attach_one_row(df, df.agg(splits))
    bucket = bucket_of(F.col(order_col).cast("double"), F.col("_splits"), n_buckets - 1)
    return with_splits.select(*[c for c in df.columns], bucket.alias("_bucket"))


def running_sums(
    df: DataFrame,
    order_col: str,
    sum_cols: list[str],
    descending: bool = False,
    n_buckets: int | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows at or before this one in order.

    ``by`` restarts the sums per group (for a few groups, e.g. metric names).
    ``order_col`` must be numeric and should be unique per row and group
    (pre-aggregated); equal values would be summed in an arbitrary order.
    """
    by = list(by or [])
    n_buckets = n_buckets or default_buckets(df)
    b = _bucket_ids(df, order_col, n_buckets, by)
    if descending:
        b = b.withColumn("_bucket", F.lit(n_buckets) - F.col("_bucket"))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.select("*", *[F.sum(c).over(w).alias(f"_loc_{c}") for c in sum_cols])
    totals = b.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    # at most n_buckets rows per group: this window is bounded
    wo = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bucket", *[F.coalesce(F.sum(f"_tot_{c}").over(wo), F.lit(0)).alias(f"_off_{c}") for c in sum_cols]
    )
    out = local.join(F.broadcast(offsets), [*by, "_bucket"], "inner")
    helper = {"_bucket", *[f"_loc_{c}" for c in sum_cols], *[f"_off_{c}" for c in sum_cols]}
    return out.select(*[c for c in out.columns if c not in helper],
                      *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sum_cols])


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(_m, _v, _n): count per distinct non-NULL value of each numeric column ``cols[_m]``.

    One unpivot and one aggregation; a hot value is one row per metric.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)
    ])).alias("_p")).select("_p._m", "_p._v").filter(F.col("_v").isNotNull())
    return pairs.groupBy("_m", "_v").agg(F.count(F.lit(1)).alias("_n"))


def quantiles_from_counts(counts: DataFrame, specs: list[tuple[int, float, str]],
                          n_buckets: int | None = None) -> DataFrame:
    """One row of exact quantiles from value counts; ``specs`` = [(metric id, q, alias)]."""
    ids = [m for m, _, _ in specs]
    counts = counts.filter(F.col("_m").isin(ids))
    cum = running_sums(counts, "_v", ["_n"], n_buckets=n_buckets, by=["_m"])
    totals = counts.groupBy("_m").agg(F.sum("_n").alias("_total"))
    qmap = F.create_map(*[x for m, q, _ in specs for x in (F.lit(m), F.lit(float(q)))])
    pos = (F.col("_total") - 1) * qmap[F.col("_m")]
    lo = F.floor(pos)
    hi = F.least(lo + 1, F.col("_total") - 1)
    start = F.col("cum__n") - F.col("_n")
    located = cum.join(F.broadcast(totals), "_m").select(
        "_m", "_v", (pos - lo).alias("_frac"),
        ((start <= lo) & (lo < F.col("cum__n"))).alias("_is_lo"),
        ((start <= hi) & (hi < F.col("cum__n"))).alias("_is_hi"),
    ).filter(F.col("_is_lo") | F.col("_is_hi"))
    per_metric = located.groupBy("_m").agg(
        F.max(F.when(F.col("_is_lo"), F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_is_hi"), F.col("_v"))).alias("_hi"),
        F.max("_frac").alias("_f"),
    ).select("_m", (F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).alias("_q"))
    # at most len(specs) rows -> one row; a metric with no values stays NULL
    return per_metric.agg(*[F.max(F.when(F.col("_m") == m, F.col("_q"))).alias(a) for m, _, a in specs])


def exact_quantiles(df: DataFrame, specs: list[tuple[str, float, str]], n_buckets: int | None = None) -> DataFrame:
    """One row with the linearly interpolated quantiles ``[(col, q, alias), ...]``.

    Same definition as pandas ``Series.quantile`` and SQL ``percentile_cont``:
    position ``q * (n - 1)`` in sorted order, NULLs ignored.  All columns are
    handled in one pass: values are unpivoted to (metric, value), counted per
    distinct pair, and ranked with :func:`running_sums` per metric.
    """
    counts = value_counts(df, [c for c, _, _ in specs])
    return quantiles_from_counts(counts, [(i, q, a) for i, (_, q, a) in enumerate(specs)], n_buckets)


def exact_quantile(df: DataFrame, col: str, q: float, alias: str, n_buckets: int | None = None) -> DataFrame:
    """One-row frame with the exact ``q`` quantile of ``col`` (see :func:`exact_quantiles`)."""
    return exact_quantiles(df, [(col, q, alias)], n_buckets)


def quantiles(df: DataFrame, specs: list[tuple[str, float, str]], approx: bool = False) -> DataFrame:
    """One-row quantile frame; exact by default, ``percentile_approx`` when ``approx``."""
    if approx:
        return df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.lit(q), F.lit(10000)).cast("double").alias(a)
                        for c, q, a in specs])
    return exact_quantiles(df, specs)


def quantile_column(df: DataFrame, col: str, q: float, alias: str, approx: bool = False) -> DataFrame:
    """One-row quantile frame; exact by default, ``percentile_approx`` when ``approx``."""
    if approx:
        return df.agg(F.percentile_approx(F.col(col).cast("double"), F.lit(q), F.lit(10000)).cast("double").alias(alias))
    return exact_quantile(df, col, q, alias)


def combine_one_row(frames: list[DataFrame]) -> DataFrame:
    """Zip several one-row frames (global aggregates) into one row.

    Each frame becomes (name, number, text) rows; the frames are unioned and
    pivoted back by one aggregate.  All branches live in one plan, so a
    shuffle they share (e.g. the master aggregate) is computed once and
    reused, and there is no join.
    """
    if len(frames) == 1:
        return frames[0]
    fields = [f for fr in frames for f in fr.schema.fields]
    longs = []
    for fr in frames:
        entries = []
        for f in fr.schema.fields:
            numeric = isinstance(f.dataType, T.NumericType)
            entries.append(F.struct(
                F.lit(f.name).alias("_k"),
                (F.col(f"`{f.name}`").cast("double") if numeric else F.lit(None).cast("double")).alias("_d"),
                (F.lit(None).cast("string") if numeric else F.col(f"`{f.name}`").cast("string")).alias("_s"),
            ))
        longs.append(fr.select(F.explode(F.array(*entries)).alias("_e")).select("_e._k", "_e._d", "_e._s"))
    u = longs[0]
    for lf in longs[1:]:
        u = u.unionByName(lf)
    aggs = []
    for f in fields:
        src = "_d" if isinstance(f.dataType, T.NumericType) else "_s"
        aggs.append(F.max(F.when(F.col("_k") == f.name, F.col(src))).cast(f.dataType).alias(f.name))
    return u.agg(*aggs)
