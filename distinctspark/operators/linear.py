"""Linear counting: one bit per hash, estimate from the share of unset bits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distinctspark.functions import sizing
from distinctspark.operators.base import Sketch, group_agg, meta_aggregates
from distinctspark.session import join_group_params


@dataclass(frozen=True)
class LinearCounting(Sketch):
    """``bits`` is a number, or the name of a column that holds each key's length.

    A length column must be constant per key; it travels as part of the state.
    """

    bits: int | str = 65536 * 8

    code: ClassVar[str] = "LC"

    @property
    def slots(self) -> tuple[str, ...]:  # type: ignore[override]
        return ("bit",) if isinstance(self.bits, int) else (self.bits, "bit")

    def _length(self) -> Column:
        return F.lit(self.bits).cast("long") if isinstance(self.bits, int) else F.col(self.bits)

    @classmethod
    def for_maximum(cls, n_max: int, error: float | None = None, **kw) -> LinearCounting:
        """Sized for at most ``n_max`` values: by the 1 % table, or for ``error``."""
        if error is None:
            bits = sizing.one_percent_bits(n_max)
        else:
            bits = sizing.bits_for_error(n_max, error)
        return cls(bits=-(-bits // 8) * 8, **kw)

    def check(self) -> None:
        if isinstance(self.bits, int) and self.bits < 1:
            raise ValueError("bits must be positive")

    def hashed(self, df, keys, value, prehashed=False):
        extra = [] if isinstance(self.bits, int) else [self.bits]
        return super().hashed(df, [*keys, *extra], value, prehashed)

    def expand(self, hashed: DataFrame) -> DataFrame:
        others = [c for c in hashed.columns if c != "h"]
        return hashed.select(*others, F.pmod(F.col("h"), self._length()).alias("bit"))

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Also gives the utilisation (share of set bits) and a saturation flag."""
        length = [] if isinstance(self.bits, int) else [F.max(self.bits).alias(self.bits)]
        totals = group_agg(
            state, keys, F.count("bit").alias("n_set"), *length, *meta_aggregates(state)
        )
        total = self._length().cast("double")
        unset = F.nullif(total - F.col("n_set"), F.lit(0.0))
        return (
            totals.withColumn("estimate", F.round(total * F.ln(total / unset)).cast("long"))
            .withColumn("utilisation", F.col("n_set") / total)
            .withColumn("saturated", F.col("n_set") == total)
        )


def with_expected_maximum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Upper bound of each key's cardinality: its number of non-null items."""
    return df.groupBy(*keys).agg(F.count(value).alias("n_max"))


def linear_counting_sized(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    error: float | None = None,
    hash: str = "xx",
) -> DataFrame:
    """Linear counting with each key's length derived from its own item count.

    Without ``error`` the 1 % table is used, else the error inequality.
    """
    bounds = with_expected_maximum(df, keys, value)
    if error is None:
        bounds = sizing.linear_bits_one_percent(bounds, "n_max")
    else:
        bits = sizing.linear_bits_for_error(F.col("n_max"), error)
        bounds = bounds.withColumn("lc_bits", (F.ceil(bits / 8) * 8).cast("long"))
    bounds = bounds.select(*keys, "lc_bits", "n_max")
    rows = join_group_params(df.select(*keys, value), bounds, keys, weight="n_max")
    return LinearCounting(hash=hash, bits="lc_bits").count(rows, keys, value)
