"""Spark's built-in sketches behind the same call shape as the relational ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hllpp_builtin(
    df: DataFrame, keys: Sequence[str], value: str, rsd: float = 0.02
) -> DataFrame:
    """HyperLogLog++ with bias correction."""
    return df.groupBy(*keys).agg(F.approx_count_distinct(value, rsd).alias("estimate"))


def hll_state(df: DataFrame, keys: Sequence[str], value: str, log2m: int = 12) -> DataFrame:
    """BINARY HyperLogLog sketch per key; mergeable, storable."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, log2m).alias("sketch_bin"))


def hll_merge(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.groupBy(*keys).agg(F.hll_union_agg("sketch_bin").alias("sketch_bin"))


def hll_lower(state: DataFrame) -> DataFrame:
    return state.withColumn("estimate", F.hll_sketch_estimate("sketch_bin")).drop("sketch_bin")


def theta_state(df: DataFrame, keys: Sequence[str], value: str, lg_k: int = 12) -> DataFrame:
    """BINARY theta sketch (a k-minimum-values relative) per key."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(value, lg_k).alias("sketch_bin"))


def theta_merge(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.groupBy(*keys).agg(F.theta_union_agg("sketch_bin").alias("sketch_bin"))


def theta_overlap(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union and intersection estimates of all sketches of a key."""
    return state.groupBy(*keys).agg(
        F.theta_sketch_estimate(F.theta_union_agg("sketch_bin")).alias("union_estimate"),
        F.theta_sketch_estimate(F.theta_intersection_agg("sketch_bin")).alias(
            "intersection_estimate"
        ),
    )


def theta_lower(state: DataFrame) -> DataFrame:
    return state.withColumn("estimate", F.theta_sketch_estimate("sketch_bin")).drop("sketch_bin")


def bitmap_exact(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact distinct count of an integer column through 32,768-bit bitmaps."""
    maps = df.groupBy(*keys, F.bitmap_bucket_number(value).alias("bitmap_no")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")
    )
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n_distinct"))
