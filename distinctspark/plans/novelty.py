"""Which rows change a sketch (the answer to offering a value).

Running the sketch row by row would put a hot key's rows in one window task.
Instead the few rows that *can* be novel are found by a bounded aggregation and
joined back by row id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distinctspark.functions.hashing import hash60, seeded_hash, trailing_zeros, with_seeds
from distinctspark.operators.base import Sketch, named_value
from distinctspark.operators.bjkst import Bjkst
from distinctspark.operators.cte import CountThenEstimate
from distinctspark.operators.kmv import KMinValues
from distinctspark.operators.registers import (
    HyperLogLogPlus,
    RegisterSketch,
    bucket_of,
    rank_of,
)
from distinctspark.plans.registry import make_sketch
from distinctspark.session import equi_join, materialize

#: Above twice the largest BIGINT, so that pairs keep their order.
PAIR_BASE = "20000000000000000000"
#: Beyond this many stretches per replay another round shortens the last one.
MANY_STRETCHES = 256
#: Methods whose state is a set of slots: a row is novel when it sets a new one.
SLOT_SETS = ("EXACT", "LC", "LCP", "FM", "BF", "BFB")


def novelty_flag(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    order: Sequence[str],
    alg: str | Sketch = "HLL",
    out: str = "is_novel",
    **params,
) -> DataFrame:
    """``df`` plus a flag; ``order`` must identify each row (arrival order + id).

    Registers: the rank exceeds every earlier rank of its bucket.  Slot sets:
    some slot was unset.  KMV: the hash is new and among the k smallest so far.
    HLLP and CTE: by the fine state up to the row that tips it, by registers after.
    BJKST: the hash is new and of at least the level some try has reached.
    """
    sketch = make_sketch(alg, **params)
    source, name = named_value(df, value)
    source = source.withColumn("_at", _position(source, order))
    rows = source.where(F.col(name).isNotNull()).select(
        *keys, "_at", hash60(name, sketch.hash).alias("h")
    )
    if isinstance(sketch, RegisterSketch):
        novel = _novel_registers(rows, keys, sketch.p)
    elif sketch.code in SLOT_SETS:
        slots = sketch.expand(rows)
        by = [c for c in slots.columns if c != "_at"]
        novel = slots.groupBy(*by).agg(F.min("_at").alias("_at"))
    elif isinstance(sketch, KMinValues):
        novel = _novel_minima(rows, keys, sketch.k)
    elif isinstance(sketch, HyperLogLogPlus):
        fine = rows.groupBy(*keys, bucket_of(F.col("h"), sketch.sp).alias("slot")).agg(
            F.min("_at").alias("_at")
        )
        before = _novel_registers(rows, keys, sketch.sp)
        after = _novel_registers(rows, keys, sketch.p)
        novel = _tipping(fine, before, after, keys, sketch.limit)
    elif isinstance(sketch, CountThenEstimate):
        fine = rows.groupBy(*keys, "h").agg(F.min("_at").alias("_at"))
        if sketch.estimator == "LC":  # over the buckets: only their first rows count
            bucket = bucket_of(F.col("h"), sketch.p).alias("bucket")
            after = rows.groupBy(*keys, bucket).agg(F.min("_at").alias("_at"))
        else:
            after = _novel_registers(rows, keys, sketch.p)
        novel = _tipping(fine, fine, after, keys, sketch.tip)
    elif isinstance(sketch, Bjkst):
        novel = _novel_levels(rows, keys, sketch)
    else:
        raise ValueError(f"no novelty rule for {sketch.code!r}")
    marks = novel.select("_at").distinct().withColumn(out, F.lit(True))
    joined = source.join(marks, "_at", "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(False))).drop("_at", "_value")


def _position(df: DataFrame, order: Sequence[str]) -> Column:
    """One orderable column for ``order``.

    Minima of structs cannot be hash-aggregated, so a (time, id) pair of integers
    becomes one exact decimal.
    """
    if len(order) == 1:
        return F.col(order[0])
    types = dict(df.dtypes)
    if len(order) == 2 and all(types[c] in ("bigint", "int") for c in order):
        wide = F.col(order[0]).cast("decimal(38,0)")
        return wide * F.lit(PAIR_BASE).cast("decimal(20,0)") + F.col(order[1])
    return F.struct(*order)


def _novel_registers(rows: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    # The first row of each (bucket, rank): at most ~60 candidates per bucket.
    first = rows.groupBy(
        *keys, bucket_of(F.col("h"), p).alias("bucket"), rank_of(F.col("h"), p).alias("rank")
    ).agg(F.min("_at").alias("_at"))
    earlier = (
        Window.partitionBy(*keys, "bucket")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = F.coalesce(F.max("rank").over(earlier), F.lit(0))
    return first.withColumn("_seen", seen).where(F.col("rank") > F.col("_seen"))


def _nth_first(firsts: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """``by``, ``_limit``: the position of each group's first row number ``n``, where it has one."""
    ranked = firsts.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_at")))
    return ranked.where(F.col("_rank") <= n).where(F.col("_rank") == n).select(
        *by, F.col("_at").alias("_limit")
    )


def _tipping(
    fine: DataFrame, before: DataFrame, after: DataFrame, keys: Sequence[str], limit: int
) -> DataFrame:
    """Rows of ``before`` up to the one whose fine slot is number ``limit`` + 1, then of ``after``.

    ``fine`` has the first row of every fine slot.
    """
    tips = materialize(_nth_first(fine, keys, limit + 1), "tips")
    early = equi_join(before.select(*keys, "_at"), tips, keys, "left")
    early = early.where(F.col("_limit").isNull() | (F.col("_at") <= F.col("_limit")))
    late = equi_join(after.select(*keys, "_at"), tips, keys, "inner")
    return early.unionByName(late.where(F.col("_at") > F.col("_limit")))


def _novel_levels(rows: DataFrame, keys: Sequence[str], sketch: Bjkst) -> DataFrame:
    """First rows of a hash that found room in some try.

    A try is above level z once buffer + 1 hashes of at least z have come.  So a hash of level z
    enters exactly if it is among the first buffer + 1 of those; that row raises the level after it.
    """
    first = rows.groupBy(*keys, "h").agg(F.min("_at").alias("_at"))
    tried = with_seeds(first, sketch.tries).select(
        *keys, F.col("seed").alias("try"), "_at", trailing_zeros(seeded_hash()).alias("level")
    )
    tried = materialize(tried, "tried")
    # A hash counts for its level and all below: two on average.
    counted = tried.withColumn("level", F.explode(F.sequence(F.lit(0), "level")))
    by = [*keys, "try", "level"]
    limits = materialize(_nth_first(counted, by, sketch.buffer + 1), "limits")
    joined = equi_join(tried, limits, by, "left")
    return joined.where(F.col("_limit").isNull() | (F.col("_at") <= F.col("_limit")))


def _novel_minima(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Replay in rounds.

    The first occurrences are range-partitioned by (keys, order), so a hot key
    spreads over many tasks; each task keeps the rows novel within its own
    stretch, which include all truly novel ones.  These few (about k * ln(n / k)
    per stretch) are replayed per key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = rows.groupBy(*keys, "h").agg(F.min("_at").alias("_at"))
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    first = first.withColumn("_group", group)
    replay = _replayer(k)

    def local(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions("_group", "_at").mapInPandas(replay, first.schema)

    stretches = local(first.repartitionByRange(parts, "_group", "_at"))
    if parts > MANY_STRETCHES:  # a round of fewer, longer stretches in between
        longer = stretches.repartitionByRange(math.isqrt(parts), "_group", "_at")
        stretches = local(longer)
    return local(stretches.repartition("_group"))


def _replayer(k: int):
    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by group and order -> those that enter the k smallest so far."""
        group, heap = None, []  # the heap holds the k smallest hashes, negated
        for batch in batches:
            keep = []
            hashes = batch["h"].to_numpy()
            names = batch["_group"].to_numpy()
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if begin == end:
                    continue
                if names[begin] != group:
                    group, heap = names[begin], []
                rest = begin
                while len(heap) < k and rest < end:
                    heapq.heappush(heap, -int(hashes[rest]))
                    keep.append(rest)
                    rest += 1
                # The bound only falls, so hashes above it now can never enter.
                for i in rest + np.flatnonzero(hashes[rest:end] < -heap[0]):
                    if hashes[i] < -heap[0]:
                        heapq.heapreplace(heap, -int(hashes[i]))
                        keep.append(i)
            yield batch.iloc[keep]

    return replay
