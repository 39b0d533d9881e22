"""BJKST: keep the hashes of high trailing-zero level, one buffer per try.

State row: (keys, try, h, level): the hashes of at least ``level`` trailing
zeros under hash number ``try``.  Each (keys, try) also has a marker row with
h = -1, so that the level survives an empty buffer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distinctspark.functions import sizing
from distinctspark.functions.hashing import seeded_hash, trailing_zeros, with_seeds
from distinctspark.operators.base import Sketch, distinct_hashes, group_agg, meta_aggregates
from distinctspark.session import equi_join, join_group_params, materialize

MARKER = -1


@dataclass(frozen=True)
class Bjkst(Sketch):
    """``tries`` independent buffers of at most ``buffer`` hashes each."""

    tries: int = 100
    set_size: int = 10
    error: float = 0.3
    combine_by: str = "median"

    code: ClassVar[str] = "BJKST"
    slots: ClassVar[tuple[str, ...]] = ("h",)
    fans_out: ClassVar[bool] = True

    @classmethod
    def for_error(cls, error: float, **kw) -> Bjkst:
        """One try with a buffer below 576 / error^2 hashes."""
        return cls(tries=1, set_size=576, error=error, **kw)

    def check(self) -> None:
        if not 0 < self.error < 1:
            raise ValueError("error must be in (0, 1)")
        if self.tries < 1 or self.combine_by not in ("median", "vote"):
            raise ValueError("need tries >= 1 and combine_by median or vote")

    @property
    def buffer(self) -> int:
        size = sizing.bjkst_buffer(self.error, self.set_size)
        # The single-try variant keeps strictly fewer than its bound.
        return size - 1 if self.tries == 1 else size

    def expand(self, hashed: DataFrame) -> DataFrame:
        return hashed

    def _tried(self, hashes: DataFrame, keys: Sequence[str]) -> DataFrame:
        rows = with_seeds(hashes.select(*keys, "h"), self.tries)
        level = trailing_zeros(seeded_hash())
        return rows.select(*keys, F.col("seed").alias("try"), "h", level.alias("tz"))

    def _levels(
        self, tried: DataFrame, keys: Sequence[str], floor: Column | None = None
    ) -> DataFrame:
        """Per (keys, try): the settled level and the buffer size there.

        Counts per level first (at most 61 rows per try), then a suffix sum.
        """
        by = [*keys, "try"]
        known = [] if floor is None else [F.max(floor).alias("_floor")]
        counts = tried.groupBy(*by, "tz").agg(
            F.count(F.when(F.col("h") != MARKER, F.lit(1))).alias("n"), *known
        )
        suffix = Window.partitionBy(*by).orderBy(F.col("tz").desc())
        counts = counts.withColumn(
            "at_least", F.sum("n").over(suffix.rowsBetween(Window.unboundedPreceding, 0))
        )
        too_many = F.max(F.when(F.col("at_least") > self.buffer, F.col("tz")))
        level = F.coalesce(too_many, F.lit(-1)) + 1
        if floor is not None:
            level = F.greatest(level, F.coalesce(F.max("_floor"), F.lit(0)))
        levels = counts.groupBy(*by).agg(
            level.alias("level"),
            F.sum("n").alias("n_rows"),
            F.collect_list(F.struct("tz", "n")).alias("counts"),  # at most 61 levels
        )
        size = F.aggregate(
            F.filter("counts", lambda c: c["tz"] >= F.col("level")),
            F.lit(0).cast("long"),
            lambda total, c: total + c["n"],
        )
        return levels.withColumn("size", size).drop("counts")

    def _combine_tries(self, levels: DataFrame, keys: Sequence[str]) -> DataFrame:
        guess = F.col("size") * F.pow(F.lit(2.0), F.col("level")).cast("long")
        guesses = levels.select(*keys, guess.alias("guess"))
        if self.combine_by == "vote":
            answer = F.mode("guess", True)
        else:
            answer = F.floor(F.median("guess"))
        return group_agg(guesses, keys, answer.cast("long").alias("estimate"))

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        if "level" in state.columns:
            levels = self._levels(
                state.withColumn("tz", F.when(F.col("h") == MARKER, 0).otherwise(F.col("tz"))),
                keys,
                F.col("level"),
            )
            return self._combine_tries(levels, keys)
        estimates = self._combine_tries(self._levels(self._tried(state, keys), keys), keys)
        meta = meta_aggregates(state)
        if not meta:
            return estimates
        return equi_join(estimates, group_agg(state, keys, *meta), keys, "inner")

    def state(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, prehashed: bool = False
    ) -> DataFrame:
        """Bounded buffers: about tries * buffer rows per key."""
        base = df.select(*[c for c in df.columns if c not in ("n_items", "first_ts", "last_ts")])
        hashes = distinct_hashes(self.hashed(base, keys, value, prehashed), keys)
        hashes = materialize(hashes, "bjkst-hashes")
        tried = self._tried(hashes, keys).withColumn("level", F.lit(0))
        return self.sign(self._settle(tried, keys))

    def combine(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        merged = rows.groupBy(*keys, "try", "h", "tz").agg(F.max("level").alias("level"))
        return self._settle(materialize(merged, "bjkst-merge"), keys)

    def _settle(self, tried: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Raise every try to the level its buffer needs and drop what lies below."""
        by = [*keys, "try"]
        levels = self._levels(tried, keys, F.col("level")).withColumnRenamed("level", "_level")
        rows = tried.drop("level").where(F.col("h") != MARKER)
        bounds = levels.select(*by, "_level", "n_rows")
        kept = join_group_params(rows, bounds, by, weight="n_rows").where("tz >= _level")
        kept = kept.withColumnRenamed("_level", "level")
        markers = levels.select(
            *by,
            F.lit(MARKER).cast("long").alias("h"),
            F.lit(0).cast("int").alias("tz"),
            F.col("_level").alias("level"),
        )
        return kept.select(*by, "h", "tz", "level").unionByName(markers)
