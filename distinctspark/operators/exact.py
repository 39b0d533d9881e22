"""Exact distinct count and item count."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distinctspark.operators.base import Sketch, group_agg, meta_aggregates


def exact_distinct(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """COUNT(DISTINCT value) per key.

    Spark plans it as a deduplication shuffled on (keys, value), so a hot key
    is spread by its values, then a count of partial counts.
    """
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_distinct"))


def item_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))


@dataclass(frozen=True)
class Exact(Sketch):
    """Exact count as a (large) sketch: the state is the set of hashes."""

    code: ClassVar[str] = "EXACT"
    slots: ClassVar[tuple[str, ...]] = ("h",)

    def expand(self, hashed: DataFrame) -> DataFrame:
        return hashed

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        return group_agg(state, keys, F.count("h").alias("estimate"), *meta_aggregates(state))
