"""Small scalar helpers shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_error(estimate: Column, truth: Column) -> Column:
    """|estimate / truth - 1|; NULL when the truth is 0."""
    return F.abs(F.try_divide(estimate.cast("double"), truth.cast("double")) - 1)


def duration(start: Column, end: Column) -> Column:
    return end - start


def key_part(metric_key: Column, index: int, separator: str = "|") -> Column:
    """The ``index``-th (0-based) part of a composite text key."""
    return F.split_part(metric_key, F.lit(separator), F.lit(index + 1))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)
