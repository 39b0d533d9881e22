"""Count then estimate: exact up to a tipping point, a register sketch beyond.

State row: (keys, h, bucket, reg).  A key below the tipping point holds its
hashes (bucket = -1); a tipped key holds registers (h = -1).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distinctspark.functions import sizing
from distinctspark.operators.base import Sketch, distinct_hashes, group_agg, meta_aggregates
from distinctspark.operators.registers import (
    adaptive_estimate,
    bucket_of,
    hll_estimate,
    loglog_estimate,
    rank_of,
)
from distinctspark.session import equi_join, join_group_params, materialize

NONE = -1
#: Above this expected maximum the default estimator is adaptive counting.
LINEAR_UP_TO = 4_250_000


@dataclass(frozen=True)
class CountThenEstimate(Sketch):
    tip: int = 1000
    p: int = 16
    estimator: str = "AC"

    code: ClassVar[str] = "CTE"
    slots: ClassVar[tuple[str, ...]] = ("h", "bucket")
    payload: ClassVar[dict] = {"reg": F.max}
    settles: ClassVar[bool] = True

    @classmethod
    def for_maximum(cls, n_max: int, **kw) -> CountThenEstimate:
        """Linear counting beyond the tip for moderate maxima, else adaptive counting."""
        if n_max < LINEAR_UP_TO:
            p = (sizing.one_percent_bits(n_max) - 1).bit_length()
            return cls(estimator="LC", p=p, **kw)
        return cls(estimator="AC", p=16, **kw)

    def check(self) -> None:
        if self.tip < 0 or not 1 <= self.p <= 30:
            raise ValueError("need tip >= 0 and p in [1, 30]")
        if self.estimator not in ("AC", "HLL", "LL", "LC"):
            raise ValueError("estimator must be AC, HLL, LL or LC")

    def expand(self, hashed: DataFrame) -> DataFrame:
        return hashed.withColumns(
            {"bucket": F.lit(NONE).cast("int"), "reg": F.lit(0).cast("int")}
        )

    def _as_registers(self, rows: DataFrame) -> DataFrame:
        exact = F.col("h") != NONE
        return rows.withColumns(
            {
                "bucket": F.when(exact, bucket_of(F.col("h"), self.p)).otherwise(F.col("bucket")),
                "reg": F.when(exact, rank_of(F.col("h"), self.p)).otherwise(F.col("reg")),
                "h": F.lit(NONE).cast("long"),
            }
        )

    def partial(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, prehashed: bool = False
    ) -> DataFrame:
        """Registers for all keys first, then exact sets only where they can stay exact.

        A key with more touched buckets than ``tip`` has surely tipped, so the
        deduplicating second pass reads only the other keys.
        """
        hashed = self.hashed(df, keys, value, prehashed)
        if "n_items" in hashed.columns:
            return self.reduce(self.expand(hashed), keys)
        registers = materialize(
            hashed.groupBy(*keys, bucket_of(F.col("h"), self.p).alias("bucket")).agg(
                F.max(rank_of(F.col("h"), self.p)).alias("reg"),
                F.count(F.lit(1)).alias("n"),
            ),
            "cte-registers",
        )
        maybe_exact = (
            registers.groupBy(*keys)
            .agg(F.count("bucket").alias("touched"), F.sum("n").alias("n"))
            .where(F.col("touched") <= self.tip)
            .drop("touched")
        )
        candidates = join_group_params(hashed, maybe_exact, keys, weight="n")
        sets = materialize(self.expand(distinct_hashes(candidates, keys)), "cte-sets")
        tipped = registers.drop("n").withColumn("h", F.lit(NONE).cast("long"))
        if not keys:  # one group: a scalar decides
            n = sets.count()
            return state_rows(sets if 0 < n <= self.tip else tipped, keys)
        sizes = sets.groupBy(*keys).agg(F.count("h").alias("n"))
        exact = equi_join(sets, sizes.where(F.col("n") <= self.tip), keys, "left_semi")
        tipped = equi_join(tipped, exact.select(*keys).distinct(), keys, "left_anti")
        return state_rows(exact, keys).unionByName(state_rows(tipped, keys))

    def combine(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Exact sets stay exact while their union is within ``tip``."""
        merged = materialize(self.reduce(rows, keys), "cte-merge")
        flags = group_agg(
            merged,
            keys,
            F.count(F.lit(1)).alias("n"),
            ((F.max("bucket") != NONE) | (F.count(F.lit(1)) > self.tip)).alias("_tipped"),
        )
        flagged = join_group_params(merged, flags, keys, weight="n")
        tipped = self.reduce(self._as_registers(flagged.where("_tipped")), keys)
        return flagged.where(~F.col("_tipped")).drop("_tipped").unionByName(tipped)

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        exact_row = F.when(F.col("h") != NONE, F.lit(1)).otherwise(F.lit(0))
        flagged = state.withColumn("_exact", exact_row)
        buckets = (
            self._as_registers(flagged)
            .groupBy(*keys, "bucket")
            .agg(
                F.max("reg").alias("reg"),
                F.sum("_exact").alias("n_exact"),
                F.min("_exact").alias("all_exact"),
                *meta_aggregates(state),
            )
        )
        totals = group_agg(
            buckets,
            keys,
            F.sum("reg").alias("reg_sum"),
            F.sum(F.pow(F.lit(2.0), -F.col("reg"))).alias("inverse_sum"),
            F.count("bucket").alias("touched"),
            F.sum("n_exact").alias("n_exact"),
            F.min("all_exact").alias("all_exact"),
            *meta_aggregates(buckets),
        )
        untipped = (F.col("all_exact") == 1) & (F.col("n_exact") <= self.tip)
        estimate = F.when(untipped, F.col("n_exact")).otherwise(self.register_estimate())
        return totals.withColumn("estimate", estimate.cast("long")).drop(
            "reg_sum", "inverse_sum", "touched", "n_exact", "all_exact"
        )

    def register_estimate(self) -> Column:
        """From reg_sum, inverse_sum and touched."""
        reg_sum, touched = F.col("reg_sum"), F.col("touched")
        if self.estimator == "AC":
            return adaptive_estimate(reg_sum, touched, self.p)
        if self.estimator == "HLL":
            return hll_estimate(F.col("inverse_sum"), touched, self.p)
        if self.estimator == "LL":
            return loglog_estimate(reg_sum, self.p)
        m = float(1 << self.p)  # linear counting over the buckets
        unset = F.nullif(F.lit(m) - touched, F.lit(0.0))
        return F.round(F.lit(m) * F.ln(F.lit(m) / unset)).cast("long")


def state_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, "h", "bucket", "reg")
