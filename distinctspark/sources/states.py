"""Sketch states as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from distinctspark.operators.base import SIGNATURE


def write_state(state: DataFrame, path: str) -> None:
    """Store a state.  The parameter signature becomes a partition folder."""
    if SIGNATURE not in state.columns:
        raise ValueError("not a signed state: build it with sketch_state()")
    state.write.mode("append").partitionBy(SIGNATURE).parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
