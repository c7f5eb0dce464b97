"""Date expressions: extended-JSON ``$date`` values, UTC timestamps, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_timestamp(col, dtype: str) -> Column:
    """Parse a date-like column to TIMESTAMP (UTC session); junk -> NULL.

    VARIANT: ``{"$date": "..."}`` takes the inner string, other values their
    text.  Strings: any ISO-8601 shape.  Timestamps pass through (NTZ values
    are read as UTC wall-clock time); dates are widened.
    """
    c = _c(col)
    if dtype == "variant":
        inner = F.coalesce(
            F.try_variant_get(c, '$["$date"]', "string"),
            F.when(~F.schema_of_variant(c).startswith("OBJECT"), F.try_variant_get(c, "$", "string")),
        )
        return F.try_to_timestamp(inner)
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp")
    return F.try_to_timestamp(c.cast("string"))


def duration_minutes(first, last) -> Column:
    """Minutes between two timestamps as DOUBLE; NULL -> 0."""
    micros = F.unix_micros(_c(last).cast("timestamp")) - F.unix_micros(_c(first).cast("timestamp"))
    return F.coalesce(micros / F.lit(6e7), F.lit(0.0))


def month_key(col) -> Column:
    """'yyyy-MM' month label of a timestamp."""
    return F.date_format(_c(col), "yyyy-MM")
