"""K minimum values: the k smallest distinct hashes of each key.

State row: (keys, h).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from distinctspark import session
from distinctspark.functions import sizing
from distinctspark.functions.hashing import HASH_BITS
from distinctspark.operators.base import (
    Sketch,
    distinct_hashes,
    group_agg,
    has_meta,
    meta_aggregates,
)

DOMAIN = float(1 << HASH_BITS)
#: Buckets per retained hash in the pruning pass.
PRUNE_FACTOR = 4
#: Rows per retained hash from which a key is worth a bound of its own.
HEAVY_FACTOR = 64
#: Rows up to which the optimizer limits ranked groups early.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Hash classes a key's hashes are spread over before they are ranked.
SPREAD = 64


def allow_group_limit(spark: SparkSession, k: int) -> None:
    """Let the optimizer cut ranked groups to ``k`` rows before they are shuffled.

    It does so up to a configured number of rows only; the setting changes plans, never results.
    """
    if int(spark.conf.get(GROUP_LIMIT)) < k:
        spark.conf.set(GROUP_LIMIT, str(k))


def smallest(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k smallest ``h`` per key, with their ``rank``; for bounded groups."""
    allow_group_limit(rows.sparkSession, k)
    by = Window.partitionBy(*keys).orderBy("h")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def smallest_per_class(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k smallest ``h`` of each of SPREAD hash classes of a key.

    A superset of the key's k smallest.  A hot key's hashes are ranked by that
    many tasks, and what is left of it is small enough for one.
    """
    allow_group_limit(rows.sparkSession, k)
    by = Window.partitionBy(*keys, F.pmod("h", F.lit(SPREAD))).orderBy("h")
    ranked = rows.withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= k).drop("rank")


def kmv_estimate(n: Column, kth: Column, k: int) -> Column:
    """Exact below k values, else (k-1) * 2^60 / h_k."""
    return (
        F.when(n < k, n)
        .otherwise(F.floor(F.lit((k - 1) * DOMAIN) / kth.cast("double")))
        .cast("long")
    )


@dataclass(frozen=True)
class KMinValues(Sketch):
    k: int = 1024

    code: ClassVar[str] = "KMV"
    slots: ClassVar[tuple[str, ...]] = ("h",)

    @classmethod
    def for_error(cls, error: float, **kw) -> KMinValues:
        return cls(k=sizing.kmv_k(error), **kw)

    def check(self) -> None:
        if self.k < 2:
            raise ValueError("k must be at least 2")

    def expand(self, hashed: DataFrame) -> DataFrame:
        return hashed

    def reduce(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Distinct hashes; at most SPREAD * k per key unless item metadata is carried."""
        distinct = super().reduce(rows, keys)
        if has_meta(distinct):
            return distinct
        return smallest_per_class(distinct, keys, self.k)

    def partial(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, prehashed: bool = False
    ) -> DataFrame:
        """The k smallest hashes per key (and a few more of small keys).

        Small keys are simply deduplicated.  For a heavy key that would shuffle
        all its distinct values, so one pass keeps only the smallest hash of each
        of ~4k hash classes (a map-side combine of bounded size).  The k-th
        smallest of those is an upper bound of the true k-th smallest, and what
        lies above it is dropped before deduplicating.  Always exact.
        """
        rows = self.hashed(df, keys, value, prehashed)
        if has_meta(rows):  # item counts need every row
            return self.reduce(rows, keys)
        heavy = self._heavy_keys(rows, keys)
        if heavy is None:
            return distinct_hashes(rows, keys)
        candidates = session.equi_join(rows, F.broadcast(heavy), keys, "left_semi")
        bounds = session.materialize(self._bounds(candidates, keys), "kmv-bounds")
        bounded = session.equi_join(rows, F.broadcast(bounds), keys, "left")
        kept = bounded.where("bound IS NULL OR h <= bound").drop("bound")
        return distinct_hashes(kept, keys)

    def _heavy_keys(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame | None:
        """Keys worth a bound: at most BROADCAST_ROW_LIMIT of them, by arithmetic."""
        counts = session.materialize(
            rows.groupBy(*keys).agg(F.count("h").alias("n")), "kmv-counts"
        )
        total, largest = counts.agg(F.sum("n"), F.max("n")).first()
        heavy_from = max(HEAVY_FACTOR * self.k, (total or 0) / session.BROADCAST_ROW_LIMIT)
        if largest is None or largest <= heavy_from:
            return None
        return counts.where(F.col("n") > heavy_from).drop("n")

    def state(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, prehashed: bool = False
    ) -> DataFrame:
        rows = self.partial(df, keys, value, prehashed).select(*keys, "h")
        return self.sign(self.trim(rows, keys))

    def _bounds(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        buckets = 1 << (PRUNE_FACTOR * self.k - 1).bit_length()
        minima = rows.groupBy(*keys, F.pmod("h", F.lit(buckets)).alias("_b")).agg(
            F.min("h").alias("h")
        )
        top = smallest(minima, keys, self.k)
        kth = F.max(F.when(F.col("rank") == self.k, F.col("h")))
        return top.groupBy(*keys).agg(
            F.coalesce(kth, F.lit(1 << HASH_BITS)).alias("bound")
        )

    def trim(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        return smallest(state, keys, self.k).drop("rank")

    def combine(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return self.trim(self.reduce(rows, keys), keys)

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        hashes = state.select(*keys, "h")
        if has_meta(state):
            hashes = smallest_per_class(hashes, keys, self.k)
        top = smallest(hashes, keys, self.k)
        totals = group_agg(top, keys, F.count("h").alias("n"), F.max("h").alias("kth"))
        estimate = kmv_estimate(F.col("n"), F.col("kth"), self.k)
        estimates = totals.withColumn("estimate", estimate).drop("n", "kth")
        if not has_meta(state):
            return estimates
        meta = group_agg(state, keys, *meta_aggregates(state))
        return session.equi_join(estimates, meta, keys, "inner")


def kmv_overlap(
    state: DataFrame, k: int, member: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Union, Jaccard and intersection of all members' sketches within each key.

    ``state`` has one KMV sketch per (keys, member), or several appended ones.  The
    union sketch is the k smallest distinct hashes of all members; the Jaccard
    similarity is the share of those that every member holds.  No member pairs are formed.
    """
    state = state.select(*keys, *member, "h").distinct()
    per_hash = state.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("held_by"))
    members = state.select(*keys, *member).distinct()
    n_members = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_members"))
    top = smallest(smallest_per_class(per_hash, keys, k), keys, k)
    # Rows per held_by level: at most one per member count, then one row per key.
    levels = top.groupBy(*keys, "held_by").agg(
        F.count(F.lit(1)).alias("n"), F.max("h").alias("kth")
    )
    joined = session.equi_join(levels, n_members, keys, "inner")
    totals = joined.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.max("kth").alias("kth"),
        F.sum(F.when(F.col("held_by") == F.col("n_members"), F.col("n")).otherwise(0)).alias(
            "n_shared"
        ),
    )
    union = kmv_estimate(F.col("n"), F.col("kth"), k)
    jaccard = F.col("n_shared") / F.col("n")
    return (
        totals.withColumn("union_estimate", union)
        .withColumn("jaccard", jaccard)
        .withColumn(
            "intersection_estimate",
            F.round(F.col("jaccard") * F.col("union_estimate")).cast("long"),
        )
        .drop("n", "kth", "n_shared")
    )


def kmv_overlap_pairs(
    state: DataFrame, pairs: DataFrame, k: int, key: str, left: str = "left", right: str = "right"
) -> DataFrame:
    """:func:`kmv_overlap` for a given table of key pairs (left, right)."""
    sides = pairs.select(left, right, F.explode(F.array(left, right)).alias(key))
    rows = sides.join(state, key)
    return kmv_overlap(rows, k, member=[key], keys=[left, right])
