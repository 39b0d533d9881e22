"""Sketches of bounded size as the state of a stream: one buffer per key and window.

KMV holds its k least hashes, BJKST its buffers and the levels they have been raised to, CTE the set
of hashes up to the tip and registers beyond.  A buffer takes hashes in any order and batches and
ends like the batch operator.  The state store holds it packed, so a window's state never exceeds
the sketch's bound, whatever it has seen.

In append mode a window comes out once, when the watermark has passed its end; in update mode after
every batch that reached it.  Rows for windows that have come out are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from distinctspark.functions.hashing import (
    HALF_BITS,
    HALF_MASK,
    HASH_BITS,
    PRIME,
    family_coefficients,
)
from distinctspark.operators.base import META, Sketch
from distinctspark.operators.bjkst import Bjkst
from distinctspark.operators.cte import CountThenEstimate
from distinctspark.operators.kmv import DOMAIN, KMinValues

#: What a buffer gives: an estimate, or -1 and what the register formulas need; and its size.
RESULT = "answer long, reg_sum long, inverse_sum double, touched long, n_held long"


def trailing_zeros(x: np.ndarray) -> np.ndarray:
    """Of 60-bit values; 60 for 0."""
    low = np.where(x == 0, 1 << HASH_BITS, x & -x)
    return np.log2(low.astype(np.float64)).astype(np.int64)  # exact for powers of two


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of 60-bit values; half by half, since doubles hold 53 bits."""
    high, low = x >> HALF_BITS, x & HALF_MASK
    return np.where(high > 0, HALF_BITS + np.frexp(high)[1], np.frexp(low)[1])


class Minima:
    """The k least distinct hashes."""

    def __init__(self, sketch: KMinValues, data: bytes = b"") -> None:
        self.k = sketch.k
        self.held = np.frombuffer(data, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        if len(self.held) == self.k:
            hashes = hashes[hashes < self.held[-1]]
        self.held = np.union1d(self.held, hashes)[: self.k]

    def pack(self) -> bytes:
        return self.held.tobytes()

    def result(self) -> tuple:
        n = len(self.held)
        answer = n if n < self.k else int((self.k - 1) * DOMAIN / float(self.held[-1]))
        return answer, 0, 0.0, 0, n


class Levels:
    """Per try, the hashes of at least its level; the level rises until they fit the buffer."""

    def __init__(self, sketch: Bjkst, data: bytes = b"") -> None:
        self.sketch = sketch
        self.family = np.array([family_coefficients(s) for s in range(sketch.tries)], np.int64)
        head = np.frombuffer(data[: 8 * 2 * sketch.tries], np.int64).reshape(2, -1)
        flat = np.frombuffer(data[8 * 2 * sketch.tries :], np.int64)
        if data:
            self.level = head[0].copy()
            self.held = np.split(flat, np.cumsum(head[1])[:-1])
        else:
            self.level = np.zeros(sketch.tries, np.int64)
            self.held = [np.zeros(0, np.int64)] * sketch.tries

    def _zeros(self, seed: slice | int, h: np.ndarray) -> np.ndarray:
        a, b, c, d, e, f = (self.family[seed, i, None] for i in range(6))
        high, low = h >> HALF_BITS, h & HALF_MASK
        left, right = (a * high + b * low + c) % PRIME, (d * high + e * low + f) % PRIME
        return trailing_zeros((left & HALF_MASK) << HALF_BITS | (right & HALF_MASK))

    def add(self, hashes: np.ndarray) -> None:
        hashes = np.unique(hashes)
        zeros = self._zeros(slice(None), hashes)
        for t in range(self.sketch.tries):
            own = np.union1d(self.held[t], hashes[zeros[t] >= self.level[t]])
            if len(own) > self.sketch.buffer:
                z = self._zeros(t, own)
                at_least = np.cumsum(np.bincount(z, minlength=HASH_BITS + 2)[::-1])[::-1]
                self.level[t] = max(self.level[t], np.argmax(at_least <= self.sketch.buffer))
                own = own[z >= self.level[t]]
            self.held[t] = own

    def pack(self) -> bytes:
        sizes = np.array([len(h) for h in self.held], np.int64)
        return self.level.tobytes() + sizes.tobytes() + np.concatenate(self.held).tobytes()

    def result(self) -> tuple:
        sizes = np.array([len(h) for h in self.held], np.int64)
        guesses = sizes << self.level
        if self.sketch.combine_by == "vote":
            values, votes = np.unique(guesses, return_counts=True)
            answer = int(values[votes.argmax()])  # the least of equals
        else:
            answer = int(np.floor(np.median(guesses)))
        return answer, 0, 0.0, 0, int(sizes.sum())


class Tipping:
    """Distinct hashes up to the tip, a register per bucket beyond."""

    def __init__(self, sketch: CountThenEstimate, data: bytes = b"\0") -> None:
        self.sketch = sketch
        self.tipped = data[:1] == b"\1"
        self.held = np.frombuffer(data[1:], np.uint8 if self.tipped else np.int64)

    def add(self, hashes: np.ndarray) -> None:
        if not self.tipped:
            self.held = np.union1d(self.held, hashes)
            if len(self.held) <= self.sketch.tip:
                return
            hashes, self.held = self.held, np.zeros(1 << self.sketch.p, np.uint8)
            self.tipped = True
        width = HASH_BITS - self.sketch.p
        rank = width + 1 - bit_length(hashes & ((1 << width) - 1))
        registers = self.held.copy()
        np.maximum.at(registers, hashes >> width, rank.astype(np.uint8))
        self.held = registers

    def pack(self) -> bytes:
        return (b"\1" if self.tipped else b"\0") + self.held.tobytes()

    def result(self) -> tuple:
        if not self.tipped:
            return len(self.held), 0, 0.0, 0, len(self.held)
        set_ = self.held[self.held > 0].astype(np.int64)
        inverse = float(np.exp2(-set_.astype(np.float64)).sum())
        return -1, int(set_.sum()), inverse, len(set_), len(set_)


BUFFERS = {KMinValues.code: Minima, Bjkst.code: Levels, CountThenEstimate.code: Tipping}


def _stepper(sketch: Sketch, n_keys: int, mode: str, columns: list[str]):
    kind = BUFFERS[sketch.code]

    def step(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        start, end = key[n_keys + 1], key[n_keys + 2]
        packed = state.get if state.exists else (None, 0, None, None)
        buffer = kind(sketch, packed[0]) if packed[0] is not None else kind(sketch)
        n_items, first, last = packed[1:]
        if state.hasTimedOut:
            state.remove()
        else:
            for frame in frames:
                buffer.add(frame["h"].to_numpy(dtype=np.int64))
                n_items += len(frame)
                low, high = int(frame["_at"].min()), int(frame["_at"].max())
                first = low if first is None else min(first, low)
                last = high if last is None else max(last, high)
            state.update((buffer.pack(), n_items, first, last))
            state.setTimeoutTimestamp(int(-(-end // 1000)))
        if state.hasTimedOut == (mode == "append"):
            row = (*key[:n_keys], start, end, n_items, first, last, *buffer.result())
            yield pd.DataFrame([row], columns=columns)

    return step


def buffered_windows(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    size: str,
    slide: str,
    sketch: Sketch,
    mode: str = "append",
) -> DataFrame:
    """keys, window, estimate, n_items, first_ts, last_ts, n_held of a stream of (keys, ts, h).

    ``n_held`` is the number of entries the window's state has come to hold.
    """
    if sketch.code not in BUFFERS:
        raise ValueError(f"{sketch.code} has no buffer; choose from {sorted(BUFFERS)}")
    if mode not in ("append", "update"):
        raise ValueError("mode is append or update")
    # Only the window carries the watermark on, so that late means: its window has come out.
    micros = F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")
    windows = rows.withColumn("window", F.window(ts, size, slide)).select(
        *keys, "window", F.unix_micros("window.start").alias("_start"),
        F.unix_micros("window.end").alias("_end"), "h", micros,
    )
    key_types = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys)
    spans = "_start long, _end long, n_items long, _first long, _last long, "
    schema = f"{key_types + ', ' if keys else ''}{spans}{RESULT}"
    columns = [*keys, *(part.split()[0] for part in f"{spans}{RESULT}".split(", "))]
    found = windows.groupBy(*keys, "window", "_start", "_end").applyInPandasWithState(
        _stepper(sketch, len(keys), mode, columns),
        schema,
        "data binary, n_items long, first long, last long",
        mode,
        GroupStateTimeout.EventTimeTimeout,
    )
    estimate: Column = F.col("answer")
    if isinstance(sketch, CountThenEstimate):
        estimate = F.when(estimate < 0, sketch.register_estimate().cast("long")).otherwise(estimate)
    window = F.struct(
        F.timestamp_micros("_start").alias("start"), F.timestamp_micros("_end").alias("end")
    )
    first, last = (F.timestamp_micros(c).alias(n) for c, n in zip(("_first", "_last"), list(META)[1:], strict=True))
    return found.select(
        *keys, window.alias("window"), estimate.alias("estimate"), "n_items", first, last, "n_held"
    )
