"""Distinct counts over event-time windows, batch or streaming.

``direct``: every event is expanded into each window that holds it.
``sliced``: events are reduced to mergeable state per slice (the greatest
common divisor of size and slide) first, and only the slice states are expanded
into windows.  With n windows per event this expands states, not events.
``intervals``: exact counts only, batch only.  A value seen in a slice is in the
windows of one index interval; the union of a value's intervals is emitted as
+1/-1 steps, and a running sum over each key's windows gives the counts.  Two
rows per value and slice instead of one per window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distinctspark.functions.hashing import hash60
from distinctspark.functions.scalars import epoch_micros
from distinctspark.operators.base import META, Sketch, named_value
from distinctspark.plans.registry import make_sketch
from distinctspark.streaming.buffers import BUFFERS, buffered_windows

STRATEGIES = ("direct", "sliced", "intervals")


def _millis(ms: int) -> str:
    return f"{ms} milliseconds"


def windowed_distinct(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    ts: str,
    size_ms: int,
    slide_ms: int | None = None,
    alg: str | Sketch = "HLL",
    strategy: str = "sliced",
    metadata: bool = False,
    output_mode: str = "append",
    **params,
) -> DataFrame:
    """keys, window, estimate [, n_items, first_ts, last_ts].

    ``slide_ms=None`` is a tumbling window.  Windows without events give no row.
    A streaming ``df`` must already carry its watermark on ``ts``.  There, KMV,
    BJKST and CTE keep a bounded buffer per key and window, whatever the strategy;
    ``output_mode="update"`` is for these only.
    """
    sketch = make_sketch(alg, **params)
    slide_ms = slide_ms or size_ms
    df, value = named_value(df, value)
    extra = []
    if metadata:
        extra = [F.lit(1).cast("long"), F.col(ts), F.col(ts)]
        extra = [c.alias(name) for name, c in zip(META, extra, strict=True)]
    # Hash before expanding, so the work is done once per event.
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, ts, hash60(value, sketch.hash).alias("h"), *extra
    )
    size, slide = _millis(size_ms), _millis(slide_ms)
    if df.isStreaming and sketch.code in BUFFERS:
        found = buffered_windows(rows, keys, ts, size, slide, sketch, output_mode)
        return found.drop("n_held") if metadata else found.select(*keys, "window", "estimate")
    if output_mode != "append":
        raise ValueError(f"{sketch.code} has no update mode here")
    dedup = not df.isStreaming
    if strategy == "direct" or slide_ms == size_ms:
        rows = rows.withColumn("window", F.window(ts, size, slide))
        by = [*keys, "window"]
        state = sketch.one_pass(rows, by, "h", prehashed=True, dedup=dedup)
        return sketch.lower(state, by)
    if strategy == "intervals":
        if sketch.code != "EXACT" or df.isStreaming or metadata:
            raise ValueError("intervals gives exact batch counts without metadata only")
        return _interval_counts(rows, keys, ts, size_ms, slide_ms)
    if strategy != "sliced":
        raise ValueError(f"unknown strategy {strategy!r}; choose from {STRATEGIES}")
    step = math.gcd(size_ms, slide_ms)
    sliced = rows.withColumn("slice", F.window(ts, _millis(step)))
    slices = sketch.one_pass(sliced, [*keys, "slice"], "h", prehashed=True, dedup=dedup)
    if sketch.settles and dedup and not metadata:  # past its bound a slice is registers
        slices = sketch.combine(slices, [*keys, "slice"])
    # A slice lies in exactly the windows that hold its event time.
    at = F.window_time("slice") if df.isStreaming else F.col("slice.start")
    expanded = slices.withColumn("window", F.window(at, size, slide)).drop("slice")
    by = [*keys, "window"]
    return sketch.lower(sketch.reduce(expanded, by), by)


def _interval_counts(
    rows: DataFrame, keys: Sequence[str], ts: str, size_ms: int, slide_ms: int
) -> DataFrame:
    """Exact distinct count of every sliding window that holds an event."""
    size, slide = size_ms * 1000, slide_ms * 1000
    step = math.gcd(size, slide)
    ntz = dict(rows.dtypes)[ts] == "timestamp_ntz"
    us = epoch_micros(F.col(ts)) if ntz else F.unix_micros(ts)
    at = F.floor(us / step).cast("long") * step
    # Windows start at multiples of the slide; index = start / slide.
    seen = rows.select(*keys, "h", at.alias("_at")).distinct()
    spans = seen.select(
        *keys,
        "h",
        (F.floor((F.col("_at") + step - size - 1) / slide) + 1).cast("long").alias("_from"),
        (F.floor(F.col("_at") / slide) + 1).cast("long").alias("_to"),
    )
    # Overlapping spans of one value merge: a span counts from where the last one ended.
    earlier = Window.partitionBy(*keys, "h").orderBy("_from", "_to")
    covered = F.lag("_to").over(earlier)
    fresh = spans.withColumn(
        "_from", F.greatest("_from", F.coalesce(covered, F.col("_from")))
    ).where(F.col("_from") < F.col("_to"))
    steps = fresh.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("_from").alias("_w"), F.lit(1).cast("long").alias("_d")),
                F.struct(F.col("_to").alias("_w"), F.lit(-1).cast("long").alias("_d")),
            )
        ),
    )
    deltas = steps.groupBy(*keys, "_w").agg(F.sum("_d").alias("_d"))
    # One row per key and window index at which the count changes.
    by_key = Window.partitionBy(*keys).orderBy("_w")
    runs = deltas.withColumns(
        {
            "estimate": F.sum("_d").over(by_key),
            "_next": F.lead("_w").over(by_key),
        }
    ).where(F.col("estimate") > 0)
    starts = runs.withColumn("_w", F.explode(F.sequence("_w", F.col("_next") - 1)))

    def stamp(micros: Column) -> Column:
        if not ntz:
            return F.timestamp_micros(micros)
        epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return F.timestamp_add("MICROSECOND", micros, epoch)

    start = F.col("_w") * slide
    window = F.struct(stamp(start).alias("start"), stamp(start + size).alias("end"))
    return starts.select(*keys, window.alias("window"), "estimate")


def flat_window(df: DataFrame, epoch) -> DataFrame:
    """Replace the window struct by window_start and window_end through ``epoch``."""
    others = [c for c in df.columns if c != "window"]
    return df.select(
        epoch(F.col("window.start")).alias("window_start"),
        epoch(F.col("window.end")).alias("window_end"),
        *others,
    )


def project_result(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The (window, key, estimate) projection of a result with metadata."""
    return df.select("window", *keys, "estimate")
