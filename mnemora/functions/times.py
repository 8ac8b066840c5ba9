"""Time expressions that do not depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    t = (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
