"""Choice of method by short code, for batch, windows and streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distinctspark.operators.base import Sketch, named_value
from distinctspark.operators.bjkst import Bjkst
from distinctspark.operators.bloom import BloomFilter
from distinctspark.operators.cte import CountThenEstimate
from distinctspark.operators.exact import Exact
from distinctspark.operators.fm import FlajoletMartin
from distinctspark.operators.kmv import KMinValues
from distinctspark.operators.linear import LinearCounting
from distinctspark.operators.packed import BlockedBloom, PackedLinearCounting
from distinctspark.operators.registers import (
    AdaptiveCounting,
    HyperLogLog,
    HyperLogLogPlus,
    LogLog,
)

SKETCHES: dict[str, type[Sketch]] = {
    cls.code: cls
    for cls in (
        Exact,
        LogLog,
        AdaptiveCounting,
        HyperLogLog,
        HyperLogLogPlus,
        LinearCounting,
        PackedLinearCounting,
        FlajoletMartin,
        KMinValues,
        BloomFilter,
        BlockedBloom,
        Bjkst,
        CountThenEstimate,
    )
}


def make_sketch(alg: str | Sketch, error: float | None = None, **params) -> Sketch:
    """A sketch from its code; with ``error`` it sizes itself for that target.

    BJKST also takes ``error`` as a plain parameter, beside ``tries``.
    """
    if isinstance(alg, Sketch):
        return alg
    if alg not in SKETCHES:
        raise ValueError(f"unknown algorithm {alg!r}; choose from {sorted(SKETCHES)}")
    cls = SKETCHES[alg]
    if error is None:
        return cls(**params)
    if "tries" in params:
        return cls(error=error, **params)
    if not hasattr(cls, "for_error"):
        raise ValueError(f"{alg} has no error-parameterised form")
    return cls.for_error(error, **params)


def approx_distinct(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    alg: str | Sketch = "HLL",
    prehashed: bool = False,
    **params,
) -> DataFrame:
    """One estimate per key with the chosen method; 0 where a key's values are all NULL."""
    found = make_sketch(alg, **params).count(df, keys, value, prehashed)
    return with_empty_keys(found, df, keys, value) if keys else found


def with_empty_keys(
    estimates: DataFrame, df: DataFrame, keys: Sequence[str], value: str | Column
) -> DataFrame:
    """``estimates`` and a row of estimate 0 for every key that has NULL values only.

    As COUNT(DISTINCT) has them.  Files whose statistics tell that they hold no NULL are not read.
    """
    df, name = named_value(df, value)
    if not df.schema[name].nullable:
        return estimates
    others = [f for f in estimates.schema if f.name not in keys]
    zeros = [
        F.lit(0 if f.name == "estimate" else None).cast(f.dataType).alias(f.name) for f in others
    ]
    empty = df.where(F.col(name).isNull()).select(*keys).distinct()
    rows = estimates.withColumn("_found", F.lit(True)).unionByName(
        empty.select(*keys, *zeros, F.lit(False).alias("_found"))
    )
    best = F.max_by(F.struct(*[f.name for f in others]), "_found").alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*")


def sketch_state(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    alg: str | Sketch = "HLL",
    prehashed: bool = False,
    **params,
) -> DataFrame:
    """Mergeable state rows; ``prehashed`` takes a 60-bit hash column as is."""
    return make_sketch(alg, **params).state(df, keys, value, prehashed)


def merge_states(
    states: Sequence[DataFrame], keys: Sequence[str], alg: str | Sketch, **params
) -> DataFrame:
    return make_sketch(alg, **params).merge(states, keys)


def estimate_states(
    state: DataFrame, keys: Sequence[str], alg: str | Sketch, **params
) -> DataFrame:
    return make_sketch(alg, **params).estimate(state, keys)
