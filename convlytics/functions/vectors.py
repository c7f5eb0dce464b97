"""Array-of-float vector expressions (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def l2_norm(col) -> Column:
    v = _c(col)
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(col) -> Column:
    """v / ||v||; a zero vector stays zero (its scores are then 0)."""
    v = _c(col)
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )
