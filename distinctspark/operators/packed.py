"""Bit sets as packed blocks: linear counting and Bloom filters of any size.

State row: (keys, block, bits): 4 KiB of bits as one BINARY, merged by OR.  Blocks without a set bit
have no row.  Against a row per set bit this is smaller from a few hundred set bits per block on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distinctspark.functions import sizing
from distinctspark.functions.hashing import HALF_BITS, hash60, high_half, low_half
from distinctspark.operators.base import (
    META,
    Sketch,
    group_agg,
    has_meta,
    meta_aggregates,
    named_value,
)
from distinctspark.session import equi_join

#: Bits of a block: what Spark's bitmap aggregates hold.
BLOCK_BITS = 32768


@dataclass(frozen=True)
class PackedSketch(Sketch):
    """Rows of (keys, block, at) are packed by one aggregate; states merge by another."""

    slots: ClassVar[tuple[str, ...]] = ("block",)

    def reduce(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        packed = F.bitmap_or_agg("bits") if "bits" in rows.columns else F.bitmap_construct_agg("at")
        return rows.groupBy(*keys, "block").agg(packed.alias("bits"), *meta_aggregates(rows))


@dataclass(frozen=True)
class PackedLinearCounting(PackedSketch):
    """Linear counting over ``bits`` bits; the same bits and estimate as :class:`LinearCounting`."""

    bits: int = 65536 * 8

    code: ClassVar[str] = "LCP"

    def check(self) -> None:
        if self.bits < 1:
            raise ValueError("bits must be positive")

    @classmethod
    def for_maximum(cls, n_max: int, error: float | None = None, **kw) -> PackedLinearCounting:
        bits = (
            sizing.one_percent_bits(n_max)
            if error is None
            else sizing.bits_for_error(n_max, error)
        )
        return cls(bits=-(-bits // 8) * 8, **kw)

    def expand(self, hashed: DataFrame) -> DataFrame:
        others = [c for c in hashed.columns if c != "h"]
        bit = F.pmod(F.col("h"), F.lit(self.bits).cast("long"))
        return hashed.select(
            *others,
            F.floor(bit / BLOCK_BITS).alias("block"),
            F.pmod(bit, F.lit(BLOCK_BITS)).alias("at"),
        )

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        totals = group_agg(
            state, keys, F.sum(F.bitmap_count("bits")).alias("n_set"), *meta_aggregates(state)
        )
        length = float(self.bits)
        unset = F.nullif(F.lit(length) - F.col("n_set"), F.lit(0.0))
        estimate = F.round(F.lit(length) * F.ln(F.lit(length) / unset)).cast("long")
        return totals.withColumn("estimate", estimate).drop("n_set")


@dataclass(frozen=True)
class BlockedBloom(PackedSketch):
    """A Bloom filter of ``blocks`` blocks; the ``k`` bits of a value lie in one of them.

    So a membership test looks at one block, and a filter of any size is a table joined by block
    number.  A hot block or value cannot arise: blocks are chosen by hash.
    """

    blocks: int = 32
    k: int = 5

    code: ClassVar[str] = "BFB"

    @classmethod
    def for_elements(cls, n: int, fpp: float, **kw) -> BlockedBloom:
        per_element, k = sizing.bloom_spec(fpp)
        return cls(blocks=max(1, math.ceil(n * per_element / BLOCK_BITS)), k=k, **kw)

    def check(self) -> None:
        if not 1 <= self.blocks < 1 << HALF_BITS or self.k < 1:
            raise ValueError("need blocks in [1, 2^30) and k >= 1")

    def _block(self, h: Column) -> Column:
        return F.pmod(high_half(h), F.lit(self.blocks).cast("long"))

    def _at(self, h: Column, i: int) -> Column:
        """Bit number ``i`` of a value: double hashing with an odd step within the block."""
        start, step = low_half(h), F.shiftright(low_half(h), 15).bitwiseOR(1)
        return (start + step * i).bitwiseAND(BLOCK_BITS - 1)

    def expand(self, hashed: DataFrame) -> DataFrame:
        others = [c for c in hashed.columns if c != "h" and c not in META]
        h = F.col("h")
        places = F.array(*[self._at(h, i) for i in range(self.k)])
        if not has_meta(hashed):
            return hashed.select(*others, self._block(h).alias("block"), F.explode(places).alias("at"))
        rows = hashed.select(*others, *META, self._block(h).alias("block"), F.posexplode(places).alias("_i", "at"))
        return rows.withColumn("n_items", F.when(F.col("_i") == 0, F.col("n_items")).otherwise(0)).drop("_i")

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Summed over the blocks, each estimated from its own share of set bits."""
        b = float(BLOCK_BITS)
        unset = F.nullif(1 - F.bitmap_count("bits") / F.lit(b), F.lit(0.0))
        own = state.withColumn("_n", -(F.lit(b) / self.k) * F.ln(unset))
        full = F.count(F.when(F.col("_n").isNull(), 1))
        totals = group_agg(own, keys, F.sum("_n").alias("_n"), full.alias("_full"), *meta_aggregates(state))
        estimate = F.when(F.col("_full") == 0, F.round("_n")).cast("long")
        return totals.withColumn("estimate", estimate).drop("_n", "_full")

    def might_contain(self, df: DataFrame, value: str | Column, state: DataFrame) -> DataFrame:
        """Rows of ``df`` whose every hash bit is set in a keyless ``state``.

        One row of ``df`` meets one block, which has its bits tested in place.  Only blocks that
        hold anything are in ``state``; how they are joined is the planner's choice by size.
        """
        df, name = named_value(df, value)
        rows = df.where(F.col(name).isNotNull()).withColumn("_h", hash60(name, self.hash))
        rows = rows.withColumn("_block", self._block(F.col("_h")))
        blocks = self.checked(state).groupBy("block").agg(F.bitmap_or_agg("bits").alias("_bits"))
        joined = equi_join(rows, blocks.withColumnRenamed("block", "_block"), ["_block"], "inner")
        hit = F.lit(True)
        for i in range(self.k):
            hit = hit & bit_is_set(F.col("_bits"), self._at(F.col("_h"), i))
        return joined.where(hit).drop("_h", "_block", "_bits", "_value")


def bit_is_set(bits: Column, at: Column) -> Column:
    """Bit number ``at`` (from 0) of a BINARY whose bytes hold their low bits first."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10)
    return F.call_function("getbit", byte.cast("long"), at.bitwiseAND(7).cast("int")) == 1
