"""The relational sketch: mergeable state as plain rows.

Every sketch is the same three steps on DataFrames:

``hashed``  one row per item: keys, hash ``h`` (NULL values dropped)
``expand``  item rows -> slot rows: keys, slot columns, payload
``reduce``  ``groupBy(keys, slots)`` with idempotent, associative aggregates
``lower``   state rows -> one estimate row per key

``reduce`` runs on slot rows and on state rows alike, so partial states merge
with the operator that built them.  Spark combines map-side, so a group sends
at most its slots per task into the shuffle, and the shuffle key includes the
slot, so one hot group spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distinctspark.functions.hashing import HASH_BITS, HASH_KINDS, hash60

#: Window/item metadata carried through every step when present.
META = {
    "n_items": F.sum,
    "first_ts": F.min,
    "last_ts": F.max,
}
SIGNATURE = "sketch"


class MergeError(ValueError):
    """States built with different parameters cannot be merged."""


@dataclass(frozen=True)
class Sketch:
    """Parameters of one distinct-count method.  Subclasses give the steps."""

    hash: str = "xx"

    code: ClassVar[str] = ""
    slots: ClassVar[tuple[str, ...]] = ()
    payload: ClassVar[dict] = {}
    #: True when one item becomes several slot rows; items are then
    #: deduplicated before expansion.
    fans_out: ClassVar[bool] = False
    #: True when :meth:`combine` changes the representation of states that grow past a bound.
    settles: ClassVar[bool] = False

    def __post_init__(self) -> None:
        if self.hash not in HASH_KINDS:
            raise ValueError(f"unknown hash kind {self.hash!r}; choose from {HASH_KINDS}")
        self.check()

    def check(self) -> None:
        """Validate parameters."""

    @property
    def signature(self) -> str:
        params = ",".join(f"{k}={v}" for k, v in sorted(vars(self).items()))
        return f"{self.code}({params})"

    # -- the steps -----------------------------------------------------------

    def hashed(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, prehashed: bool | int = False
    ) -> DataFrame:
        df, value = named_value(df, value)
        kind = df.schema[value].dataType
        if (prehashed or self.hash == "mix") and not isinstance(kind, T.IntegralType):
            raise TypeError(f"{value} is {kind.simpleString()}; integers are needed here")
        h = given_hash(value, prehashed) if prehashed else hash60(value, self.hash)
        meta = [c for c in META if c in df.columns]
        return df.where(F.col(value).isNotNull()).select(*keys, *meta, h.alias("h"))

    def expand(self, hashed: DataFrame) -> DataFrame:
        raise NotImplementedError

    def reduce(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        aggs = [fn(name).alias(name) for name, fn in self.payload.items()]
        aggs += meta_aggregates(rows)
        by = [*keys, *self.slots]
        return rows.groupBy(*by).agg(*aggs) if aggs else rows.select(*by).distinct()

    def state(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, prehashed: bool | int = False
    ) -> DataFrame:
        """Mergeable state of every key."""
        return self.sign(self.partial(df, keys, value, prehashed))

    def partial(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, prehashed: bool | int = False
    ) -> DataFrame:
        """State without the parameter signature.

        Subclasses may override it with a plan that shuffles less but reads
        the input twice; :meth:`one_pass` always reads it once.
        """
        return self.one_pass(df, keys, value, prehashed)

    def one_pass(
        self,
        df: DataFrame,
        keys: Sequence[str],
        value: str | Column,
        prehashed: bool | int = False,
        dedup: bool = True,
    ) -> DataFrame:
        """hashed -> expand -> reduce; lazy, and valid on streams too."""
        rows = self.hashed(df, keys, value, prehashed)
        if self.fans_out and dedup:
            rows = distinct_hashes(rows, keys)
        return self.reduce(self.expand(rows), keys)

    def lower(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        """keys, estimate BIGINT (NULL when saturated), and any metadata."""
        raise NotImplementedError

    # -- states as tables ----------------------------------------------------

    def sign(self, state: DataFrame) -> DataFrame:
        return state.withColumn(SIGNATURE, F.lit(self.signature))

    def checked(self, state: DataFrame) -> DataFrame:
        """Fail on rows built with other parameters."""
        if SIGNATURE not in state.columns:
            return state
        same = F.col(SIGNATURE) == F.lit(self.signature)
        message = F.concat(F.lit(f"cannot merge into {self.signature}: "), F.col(SIGNATURE))
        guard = F.when(same, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        return state.where(guard).drop(SIGNATURE)

    def merge(self, states: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
        """One state per key out of any number of states with at least those keys."""
        if not states:
            raise MergeError("nothing to merge")
        columns = set(states[0].columns)
        if any(set(s.columns) != columns for s in states):
            raise MergeError("states differ in columns, so in method")
        rows = self.checked(states[0])
        for other in states[1:]:
            rows = rows.unionByName(self.checked(other))
        return self.sign(self.combine(rows, keys))

    def combine(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return self.reduce(rows, keys)

    def estimate(self, state: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Estimates of a state table; rows appended without a merge are merged first."""
        return self.lower(self.combine(self.checked(state), keys), keys)

    def count(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, prehashed: bool | int = False
    ) -> DataFrame:
        """Rows in, one estimate per key out."""
        return self.lower(self.partial(df, keys, value, prehashed), keys)


def given_hash(value: str, prehashed: bool | int) -> Column:
    """60 bits of a given hash: the value itself, or the top bits of one of 64 bits.

    ``prehashed=64`` declares signed or unsigned 64-bit hashes.  ``True`` declares 60 bits, and a
    value outside them is an error.
    """
    column = F.col(value).cast("long")
    if prehashed is not True:
        if prehashed != 64:
            raise ValueError("prehashed is True for 60-bit hashes, or 64")
        return F.shiftrightunsigned(column, 64 - HASH_BITS)
    fits = (column >= 0) & (column < 1 << HASH_BITS)
    message = F.concat(F.lit("not a 60-bit hash: "), column.cast("string"))
    return F.when(fits, column).otherwise(F.raise_error(message).cast("long"))


def named_value(df: DataFrame, value: str | Column) -> tuple[DataFrame, str]:
    """``df`` with the value as a named column."""
    if isinstance(value, str):
        return df, value
    return df.withColumn("_value", value), "_value"


def meta_aggregates(rows: DataFrame) -> list[Column]:
    return [fn(name).alias(name) for name, fn in META.items() if name in rows.columns]


def has_meta(rows: DataFrame) -> bool:
    return any(name in rows.columns for name in META)


def distinct_hashes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, h): balanced on the hash, whatever the key skew."""
    aggs = meta_aggregates(rows)
    return rows.groupBy(*keys, "h").agg(*aggs) if aggs else rows.distinct()


def fanned_meta(rows: DataFrame, copy: Column) -> list[Column]:
    """Metadata columns after an expansion: only copy 0 keeps its item count."""
    out = []
    for name in META:
        if name in rows.columns:
            column = F.col(name)
            out.append(
                F.when(copy == 0, column).otherwise(F.lit(0)).alias(name)
                if name == "n_items"
                else column
            )
    return out


def group_agg(rows: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """groupBy(keys) that also works for no keys (one global row)."""
    return rows.groupBy(*keys).agg(*aggs)
