"""Flajolet-Martin bitmaps.

State row: (keys, seed, bits): the set of trailing-zero ranks seen by hash
number ``seed``, OR-ed together.  A key holds one row per hash function, so the
map-side combine sends that many rows of a key and task, whatever its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distinctspark.functions import sizing
from distinctspark.functions.hashing import (
    lowest_unset_bit,
    seeded_hash,
    trailing_zeros,
    with_seeds,
)
from distinctspark.operators.base import META, Sketch, fanned_meta, group_agg, meta_aggregates

PHI = 0.77351


@dataclass(frozen=True)
class FlajoletMartin(Sketch):
    """``groups`` x ``hashes`` bitmaps: mean rank in a group, median over groups."""

    groups: int = 3
    hashes: int = 3

    code: ClassVar[str] = "FM"
    slots: ClassVar[tuple[str, ...]] = ("seed",)
    payload: ClassVar[dict] = {"bits": F.bit_or}

    @classmethod
    def for_error(cls, error: float, **kw) -> FlajoletMartin:
        """One group of as many hashes as the error asks for."""
        return cls(groups=1, hashes=sizing.fm_hashes(error), **kw)

    def check(self) -> None:
        if self.groups < 1 or self.hashes < 1:
            raise ValueError("groups and hashes must be positive")

    def expand(self, hashed: DataFrame) -> DataFrame:
        keys = [c for c in hashed.columns if c not in ("h", *META)]
        return with_seeds(hashed, self.groups * self.hashes).select(
            *keys,
            *fanned_meta(hashed, F.col("seed")),
            "seed",
            F.call_function(
                "shiftleft", F.lit(1).cast("long"), trailing_zeros(seeded_hash())
            ).alias("bits"),
        )

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        ranked = state.withColumn("r", lowest_unset_bit(F.col("bits"))).withColumn(
            "grp", F.floor(F.col("seed") / self.hashes)
        )
        means = ranked.groupBy(*keys, "grp").agg(
            (F.sum("r") / F.lit(self.hashes)).alias("mean_r"), *meta_aggregates(state)
        )
        totals = group_agg(
            means, keys, F.median("mean_r").alias("r"), *meta_aggregates(means)
        )
        estimate = F.floor(F.pow(F.lit(2.0), F.col("r")) / PHI).cast("long")
        return totals.withColumn("estimate", estimate).drop("r")
