"""Bloom filters: cardinality, sizing, membership.

State row: (keys, bit), the set bits only, at most ``bits`` per key and per
task of the map-side combine.  Larger filters are packed: see ``packed``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distinctspark.functions import sizing
from distinctspark.functions.hashing import (
    HALF_BITS,
    bloom_position,
    bloom_positions,
    evaluated_once,
    hash60,
)
from distinctspark.operators.base import (
    Sketch,
    fanned_meta,
    group_agg,
    meta_aggregates,
    named_value,
)

#: A filter of up to this many bits (1 MiB) is tested as one packed constant.
PACKED_LIMIT_BITS = 1 << 23
WORD_BITS = 62


@dataclass(frozen=True)
class BloomFilter(Sketch):
    bits: int = 1 << 20
    k: int = 5
    formula: str = "swamidass"

    code: ClassVar[str] = "BF"
    slots: ClassVar[tuple[str, ...]] = ("bit",)

    @classmethod
    def for_elements(cls, n: int, fpp: float, **kw) -> BloomFilter:
        per_element, k = sizing.bloom_spec(fpp)
        return cls(bits=n * per_element, k=k, **kw)

    def check(self) -> None:
        if not 2 <= self.bits < 1 << HALF_BITS:
            raise ValueError("bits must be in [2, 2^30)")
        if self.k < 1 or self.formula not in ("swamidass", "papapetrou"):
            raise ValueError("need k >= 1 and a known formula")

    def expand(self, hashed: DataFrame) -> DataFrame:
        keys = [c for c in hashed.columns if c not in ("h", "n_items", "first_ts", "last_ts")]
        positions = bloom_positions(F.col("h"), self.k, self.bits)
        rows = hashed.select("*", F.posexplode(positions).alias("i", "bit"))
        return rows.select(*keys, *fanned_meta(hashed, F.col("i")), "bit")

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        totals = group_agg(state, keys, F.count("bit").alias("n_set"), *meta_aggregates(state))
        b = float(self.bits)
        share_unset = F.nullif(1 - F.col("n_set") / F.lit(b), F.lit(0.0))
        if self.formula == "swamidass":
            estimate = -(F.lit(b) / self.k) * F.ln(share_unset)
        else:
            estimate = F.ln(share_unset) / (F.lit(float(self.k)) * F.ln(F.lit(1 - 1 / b)))
        return (
            totals.withColumn("estimate", F.floor(estimate).cast("long"))
            .withColumn("saturated", F.col("n_set") == self.bits)
            .drop("n_set")
        )

    # -- membership ----------------------------------------------------------

    def might_contain(self, df: DataFrame, value: str | Column, state: DataFrame) -> DataFrame:
        """Rows of ``df`` whose every hash bit is set in a keyless ``state``."""
        if self.bits <= PACKED_LIMIT_BITS:
            return self._filter_packed(df, value, state)
        return self._filter_joined(df, value, state)

    def _filter_packed(self, df: DataFrame, value: str | Column, state: DataFrame) -> DataFrame:
        """Bits packed into one array, embedded by a scalar subquery: no shuffle of ``df``."""
        n_words = -(-self.bits // WORD_BITS)
        one = F.lit(1).cast("long")
        word = F.floor(F.col("bit") / WORD_BITS).cast("int")
        mask = F.call_function("shiftleft", one, F.pmod("bit", F.lit(WORD_BITS)).cast("int"))
        words = self.checked(state).groupBy(word.alias("w")).agg(F.bit_or(mask).alias("mask"))
        every = df.sparkSession.range(n_words).select(F.col("id").cast("int").alias("w"))
        filled = every.join(words, "w", "left").select(
            F.struct("w", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")).alias("word")
        )
        packed = (
            filled.agg(F.sort_array(F.collect_list("word")).alias("words"))
            .select(F.col("words.mask"))
            .scalar()
        )
        df, name = named_value(df, value)
        hashed = evaluated_once(hash60(name, self.hash))
        tested = df.where(F.col(name).isNotNull()).withColumn("_h", hashed)
        # K plain bit tests that stop at the first miss; the subquery runs once.
        hit = F.lit(True)
        for i in range(self.k):
            at = bloom_position(F.col("_h"), i, self.bits)
            found = F.get(packed, F.floor(at / WORD_BITS).cast("int"))
            hit = hit & (F.call_function("getbit", found, F.pmod(at, F.lit(WORD_BITS))) == 1)
        return tested.where(hit).drop("_h", "_value")

    def _filter_joined(self, df: DataFrame, value: str | Column, state: DataFrame) -> DataFrame:
        """Distinct hashes joined to the bits; those with all K bits present pass."""
        df, name = named_value(df, value)
        rows = df.where(F.col(name).isNotNull()).withColumn("_h", hash60(name, self.hash))
        positions = bloom_positions(F.col("_h"), self.k, self.bits)
        probes = (
            rows.select("_h").distinct().select("_h", F.posexplode(positions).alias("i", "bit"))
        )
        passing = (
            probes.join(self.checked(state).select("bit").distinct(), "bit")
            .groupBy("_h")
            .agg(F.count("i").alias("n"))
            .where(F.col("n") == self.k)
        )
        return rows.join(passing.select("_h"), "_h", "left_semi").drop("_h", "_value")


def bloom_sizing(groups: DataFrame, n: str, target: str) -> DataFrame:
    """Cheapest filter per row: bits per element, K, total bits, resulting FPP.

    Each distinct target is matched once against the (fixed, <100-row) choice
    table; the table of targets is then joined back.
    """
    choices = F.broadcast(sizing.bloom_candidates(groups.sparkSession))
    targets = groups.select(target).distinct()
    meets = F.when(F.col("fpp") <= F.col(target), F.struct("bits_per_element", "k"))
    best = (
        targets.join(choices, F.col("fpp") <= F.col(target), "left")
        .groupBy(target)
        .agg(F.min(meets).alias("best"))
    )
    fallback = F.struct(
        F.lit(sizing.BLOOM_MAX_BITS).alias("bits_per_element"),
        F.lit(sizing.BLOOM_MAX_K).alias("k"),
    )
    best = best.withColumn("best", F.coalesce("best", fallback))
    sized = groups.join(best, target)
    k, per = F.col("best.k"), F.col("best.bits_per_element")
    return (
        sized.withColumn("bits_per_element", per)
        .withColumn("k", k)
        .withColumn("bits", F.col(n) * per)
        .withColumn("fpp", sizing.false_positive_rate(k, per))
        .drop("best")
    )
