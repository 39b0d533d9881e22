"""Exact and approximate distinct counting on Spark.

Everything is a DataFrame in, a DataFrame out: sketches over keys, their
mergeable states, event-time windows, streams, and the accuracy and timing
reports about them.
"""

from distinctspark.operators.base import MergeError, Sketch
from distinctspark.plans.registry import (
    SKETCHES,
    approx_distinct,
    estimate_states,
    make_sketch,
    merge_states,
    sketch_state,
)
from distinctspark.plans.windows import windowed_distinct

__all__ = [
    "SKETCHES",
    "MergeError",
    "Sketch",
    "approx_distinct",
    "estimate_states",
    "make_sketch",
    "merge_states",
    "sketch_state",
    "windowed_distinct",
]
