"""Numeric label helpers: 0/1 coercion and message-volume buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message-volume buckets, right-closed, lowest edge included:
# [0,2] (2,5] (5,10] (10,20] (20,50] (50,100] (100,inf).
VOLUME_BUCKETS = [
    ("0-2", 2),
    ("3-5", 5),
    ("6-10", 10),
    ("11-20", 20),
    ("21-50", 50),
    ("51-100", 100),
    ("100+", None),
]


def coerce_label(col) -> Column:
    """NULL -> 0, then integer cast (booleans 0/1, decimals truncate, text raises under ANSI)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("int"), F.lit(0))


def volume_bucket(col) -> Column:
    """Bucket label of a message count (NULL stays NULL, negatives too)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for label, upper in VOLUME_BUCKETS:
        cond = c > F.lit(100) if upper is None else c <= F.lit(upper)
        expr = F.when(cond & (c >= 0), F.lit(label)) if expr is None else expr.when(cond & (c >= 0), F.lit(label))
    return expr


def volume_bucket_dim(spark):
    """The 7-row bucket dimension (label, ordinal) used to emit empty buckets."""
    return spark.createDataFrame(
        [(label, i) for i, (label, _) in enumerate(VOLUME_BUCKETS)], "msg_bucket string, bucket_order int"
    )
