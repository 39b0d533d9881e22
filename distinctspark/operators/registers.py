"""Register sketches: LogLog, adaptive counting, HyperLogLog, HyperLogLog++.

State row: (keys, bucket, reg).  Only touched buckets are stored, at most 2^p
per key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distinctspark import session
from distinctspark.functions import bias, sizing
from distinctspark.functions.hashing import HASH_BITS, leading_rank
from distinctspark.operators.base import Sketch, group_agg, has_meta, meta_aggregates

# HyperLogLog alpha for m = 16, 32, 64.
HLL_ALPHA_SMALL = {4: 0.673, 5: 0.697, 6: 0.709}
#: Share of empty buckets at which adaptive counting switches to LogLog.
ADAPTIVE_SWITCH = 0.051


def bucket_of(h: Column, p: int) -> Column:
    return F.shiftright(h, HASH_BITS - p).cast("int")


def rank_of(h: Column, p: int) -> Column:
    width = HASH_BITS - p
    return leading_rank(h.bitwiseAND((1 << width) - 1), width).cast("int")


def loglog_alpha_m(p: int) -> float:
    """m * alpha_m = m * (gamma(-1/m) * (1 - 2^(1/m)) / ln 2)^-m, for m = 2^p registers.

    gamma(-1/m) = -m * gamma(1 - 1/m), so the base is gamma(1 - e) * (expm1(x) / x) with e = 1/m and
    x = ln 2 / m.  Both factors are near 1; for large m their logarithms come from series, since
    rounding is raised to the m-th power too.
    """
    m = 1 << p
    if m == 1:
        return 0.0
    e, x = 1 / m, math.log(2) / m
    if p < 8:
        log = math.lgamma(1 - e) + math.log(math.expm1(x) / x)
    else:
        euler, zeta3 = 0.5772156649015329, 1.2020569031595942
        log = euler * e + math.pi**2 / 12 * e**2 + zeta3 / 3 * e**3 + x / 2 + x**2 / 24
    return m * math.exp(-m * log)


def hll_alpha(p: int) -> float:
    return HLL_ALPHA_SMALL.get(p, 0.7213 / (1 + 1.079 / (1 << p)))


def loglog_estimate(reg_sum: Column, p: int) -> Column:
    m = 1 << p
    return F.floor(F.lit(loglog_alpha_m(p)) * F.pow(F.lit(2.0), reg_sum / F.lit(float(m))))


def hll_estimate(inverse_sum: Column, touched: Column, p: int) -> Column:
    """Raw estimate with the small-range correction; no large-range one (60-bit hash)."""
    m = 1 << p
    zeros = F.lit(m) - touched
    raw = F.lit(hll_alpha(p) * m * m) / (inverse_sum + zeros)
    small = F.round(F.lit(float(m)) * F.ln(F.lit(float(m)) / F.nullif(zeros, F.lit(0))))
    return F.when((raw <= 2.5 * m) & (zeros > 0), small).otherwise(F.round(raw)).cast("long")


def adaptive_estimate(reg_sum: Column, touched: Column, p: int) -> Column:
    m = 1 << p
    empty = (F.lit(m) - touched) / F.lit(float(m))
    linear = F.round(F.lit(-float(m)) * F.ln(F.nullif(empty, F.lit(0.0))))
    return (
        F.when(empty >= ADAPTIVE_SWITCH, linear)
        .otherwise(loglog_estimate(reg_sum, p).cast("double"))
        .cast("long")
    )


@dataclass(frozen=True)
class RegisterSketch(Sketch):
    p: int = 12

    slots: ClassVar[tuple[str, ...]] = ("bucket",)
    payload: ClassVar[dict] = {"reg": F.max}

    def check(self) -> None:
        if not 1 <= self.p <= 30:
            raise ValueError(f"p must be in [1, 30], not {self.p}")

    def expand(self, hashed: DataFrame) -> DataFrame:
        others = [c for c in hashed.columns if c != "h"]
        h = F.col("h")
        return hashed.select(
            *others, bucket_of(h, self.p).alias("bucket"), rank_of(h, self.p).alias("reg")
        )

    def formula(self, reg_sum: Column, inverse_sum: Column, touched: Column) -> Column:
        raise NotImplementedError

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        totals = group_agg(
            state,
            keys,
            F.sum("reg").alias("reg_sum"),
            F.sum(F.pow(F.lit(2.0), -F.col("reg"))).alias("inverse_sum"),
            F.count("bucket").alias("touched"),
            *meta_aggregates(state),
        )
        estimate = self.formula(F.col("reg_sum"), F.col("inverse_sum"), F.col("touched"))
        return totals.withColumn("estimate", estimate.cast("long")).drop(
            "reg_sum", "inverse_sum", "touched"
        )


@dataclass(frozen=True)
class LogLog(RegisterSketch):
    code: ClassVar[str] = "LL"

    @classmethod
    def for_error(cls, error: float, **kw) -> LogLog:
        return cls(p=sizing.loglog_registers(error).bit_length() - 1, **kw)

    def formula(self, reg_sum: Column, inverse_sum: Column, touched: Column) -> Column:
        return loglog_estimate(reg_sum, self.p)


@dataclass(frozen=True)
class AdaptiveCounting(RegisterSketch):
    code: ClassVar[str] = "AC"

    def formula(self, reg_sum: Column, inverse_sum: Column, touched: Column) -> Column:
        return adaptive_estimate(reg_sum, touched, self.p)


@dataclass(frozen=True)
class HyperLogLog(RegisterSketch):
    code: ClassVar[str] = "HLL"

    @classmethod
    def for_rsd(cls, rsd: float, **kw) -> HyperLogLog:
        return cls(p=sizing.hll_log2m(rsd), **kw)

    @classmethod
    def for_error(cls, error: float, **kw) -> HyperLogLog:
        p = sizing.hll_registers(error).bit_length() - 1
        if p < 4:
            raise ValueError(f"error {error} needs fewer than 16 registers")
        return cls(p=p, **kw)

    def formula(self, reg_sum: Column, inverse_sum: Column, touched: Column) -> Column:
        return hll_estimate(inverse_sum, touched, self.p)


SPARSE, DENSE = 0, 1
#: Neighbours in the bias table whose mean is taken off the raw estimate.
NEIGHBOURS = 6


def raw_estimate(inverse_sum: Column, touched: Column, p: int) -> Column:
    m = 1 << p
    return F.lit(hll_alpha(p) * m * m) / (inverse_sum + (F.lit(m) - touched))


def bias_corrected(inverse_sum: Column, touched: Column, p: int) -> Column:
    """The raw estimate less its expected bias, or linear counting below the precision's threshold.

    The bias is the mean of the table's NEIGHBOURS nearest raw estimates; up to 5 m, and none above
    the precisions that have a table.
    """
    m = 1 << p
    raw = raw_estimate(inverse_sum, touched, p)
    zeros = F.lit(m) - touched
    linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / F.nullif(zeros, F.lit(0)))
    if not bias.LEAST_P <= p <= bias.MOST_P:
        use_linear = (raw <= 5.0 * m) & (zeros > 0)
        return F.round(F.when(use_linear, linear).otherwise(raw)).cast("long")
    raws, biases = bias.bias_table(p, hll_alpha(p))
    far = F.transform(
        F.lit(list(raws)),
        lambda r, i: F.struct(F.abs(r - raw).alias("d"), F.get(F.lit(list(biases)), i).alias("b")),
    )
    nearest = F.slice(F.array_sort(far), 1, NEIGHBOURS)
    total = F.aggregate(nearest, F.lit(0.0), lambda t, x: t + x["b"])
    corrected = F.when(raw <= 5.0 * m, raw - total / NEIGHBOURS).otherwise(raw)
    below = F.coalesce(linear, corrected) < bias.LINEAR_BELOW[p - bias.LEAST_P]
    return F.round(F.when(below, F.coalesce(linear, corrected)).otherwise(corrected)).cast("long")


@dataclass(frozen=True)
class HyperLogLogPlus(Sketch):
    """HyperLogLog++: a sparse phase, then dense registers, merged in any mix.

    State row: (keys, form, idx, reg).  Sparse rows hold the first ``sp`` hash bits and the rank of
    the rest, so the dense registers of precision ``p`` can be derived from them.  A key with more
    than 0.75 * 2^p sparse rows is dense instead: its rows are registers, so no key holds more than
    2^p rows.  The estimate is linear counting over 2^sp while a key is sparse, else the dense one;
    ``bias`` takes the expected bias off the latter.
    """

    p: int = 12
    sp: int = 18
    bias: bool = False

    code: ClassVar[str] = "HLLP"
    slots: ClassVar[tuple[str, ...]] = ("form", "idx")
    payload: ClassVar[dict] = {"reg": F.max}
    settles: ClassVar[bool] = True

    def check(self) -> None:
        if not 4 <= self.p <= self.sp <= 30:
            raise ValueError("need 4 <= p <= sp <= 30")

    @property
    def limit(self) -> int:
        """Sparse rows a key may hold."""
        return int(0.75 * (1 << self.p))

    def expand(self, hashed: DataFrame) -> DataFrame:
        others = [c for c in hashed.columns if c != "h"]
        h = F.col("h")
        return hashed.select(
            *others,
            F.lit(SPARSE).alias("form"),
            bucket_of(h, self.sp).alias("idx"),
            rank_of(h, self.sp).alias("reg"),
        )

    def partial(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, prehashed: bool | int = False
    ) -> DataFrame:
        """Registers of all keys first, then sparse rows only where a key can stay sparse.

        A key that touches more registers than it may hold sparse rows is surely dense, so the
        finer second pass never shuffles more than a bounded number of rows of a key and task.
        """
        hashed = self.hashed(df, keys, value, prehashed)
        if has_meta(hashed):  # item counts need every row
            return self.reduce(self.expand(hashed), keys)
        bucket = bucket_of(F.col("h"), self.p).alias("idx")
        registers = session.materialize(
            hashed.groupBy(*keys, bucket).agg(
                F.max(rank_of(F.col("h"), self.p)).alias("reg"), F.count(F.lit(1)).alias("n")
            ),
            "hllpp-registers",
        )
        maybe_sparse = (
            group_agg(registers, keys, F.count("idx").alias("touched"), F.sum("n").alias("n"))
            .where(F.col("touched") <= self.limit)
            .drop("touched")
        )
        candidates = session.join_group_params(hashed, maybe_sparse, keys, weight="n")
        sets = session.materialize(self.reduce(self.expand(candidates), keys), "hllpp-sparse")
        few = group_agg(sets, keys, F.count(F.lit(1)).alias("n")).where(
            F.col("n").between(1, self.limit)
        )
        sparse = session.equi_join(sets, few.drop("n"), keys, "left_semi")
        dense = registers.select(*keys, F.lit(DENSE).alias("form"), "idx", "reg")
        dense = session.equi_join(dense, few.drop("n"), keys, "left_anti")
        return sparse.select(*keys, "form", "idx", "reg").unionByName(dense)

    def _as_registers(self, rows: DataFrame) -> DataFrame:
        """Sparse rows as the dense registers they imply."""
        gap = self.sp - self.p
        tail = F.col("idx").bitwiseAND((1 << gap) - 1)
        rank = F.when(tail == 0, F.lit(gap) + F.col("reg")).otherwise(leading_rank(tail, gap))
        sparse = F.col("form") == SPARSE
        return rows.withColumns(
            {
                "idx": F.when(sparse, F.shiftright("idx", gap)).otherwise(F.col("idx")),
                "reg": F.when(sparse, rank).otherwise(F.col("reg")),
                "form": F.lit(DENSE),
            }
        )

    def combine(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Sparse and sparse stay sparse up to the limit; any other pair is dense."""
        merged = self.reduce(rows, keys)
        if has_meta(merged):
            return merged
        merged = session.materialize(merged, "hllpp-merge")
        flags = group_agg(
            merged,
            keys,
            F.count(F.lit(1)).alias("n"),
            ((F.max("form") == DENSE) | (F.count(F.lit(1)) > self.limit)).alias("_dense"),
        )
        flagged = session.join_group_params(merged, flags, keys, weight="n")
        dense = self.reduce(self._as_registers(flagged.where("_dense")).drop("_dense"), keys)
        return flagged.where(~F.col("_dense")).drop("_dense").unionByName(dense)

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        sparse = F.when(F.col("form") == SPARSE, 1).otherwise(0)
        rows = self._as_registers(state.withColumn("_sparse", sparse))
        registers = rows.groupBy(*keys, "idx").agg(
            F.max("reg").alias("reg"),
            F.sum("_sparse").alias("n_sparse"),
            F.min("_sparse").alias("all_sparse"),
            *meta_aggregates(state),
        )
        totals = group_agg(
            registers,
            keys,
            F.sum("n_sparse").alias("n_sparse"),
            F.min("all_sparse").alias("all_sparse"),
            F.sum(F.pow(F.lit(2.0), -F.col("reg"))).alias("inverse_sum"),
            F.count("idx").alias("touched"),
            *meta_aggregates(registers),
        )
        sm = float(1 << self.sp)
        left = F.nullif(F.lit(sm) - F.col("n_sparse"), F.lit(0.0))
        linear = F.round(F.lit(sm) * F.ln(F.lit(sm) / left)).cast("long")
        formula = bias_corrected if self.bias else hll_estimate
        dense = formula(F.col("inverse_sum"), F.col("touched"), self.p)
        is_sparse = (F.col("all_sparse") == 1) & (F.col("n_sparse") <= self.limit)
        return totals.withColumn("estimate", F.when(is_sparse, linear).otherwise(dense)).drop(
            "n_sparse", "all_sparse", "inverse_sum", "touched"
        )
