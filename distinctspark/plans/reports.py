"""Latency and throughput summaries over measurement records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distinctspark.functions.scalars import duration
from distinctspark.operators.ordered import cumulative_share, mean_and_median

RUN_KEYS = ("approach", "algorithm", "tps", "dist", "run")


def latency_summary(
    records: DataFrame, start: str, end: str, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Mean and exact median duration per run."""
    timed = records.select(*keys, duration(F.col(start), F.col(end)).alias("duration"))
    return mean_and_median(timed, keys, "duration")


def throughput_cdf(records: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Share of all counted items that were out by each out_time, per run."""
    return cumulative_share(
        records.select(*keys, "out_time", "window_count"), keys, "out_time", "window_count"
    )
