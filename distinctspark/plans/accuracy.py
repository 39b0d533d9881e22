"""Estimates of all methods against the exact answer."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from distinctspark.functions.hashing import hash60
from distinctspark.functions.scalars import relative_error
from distinctspark.operators.base import Sketch, distinct_hashes
from distinctspark.session import equi_join, materialize


def distinct_table(
    df: DataFrame, keys: Sequence[str], value: str, methods: Mapping[str, Sketch]
) -> DataFrame:
    """The input read and deduplicated once, as a (keys, h) table in the shared folder."""
    kinds = {m.hash for m in methods.values()}
    if len(kinds) != 1:
        raise ValueError("all methods must use the same hash kind")
    present = df.where(F.col(value).isNotNull())
    rows = present.select(*keys, hash60(value, kinds.pop()).alias("h"))
    return materialize(distinct_hashes(rows, keys), "distinct")


def estimates_of(base: DataFrame, keys: Sequence[str], methods: Mapping[str, Sketch]) -> DataFrame:
    """Long form (name, keys, estimate) of several methods over one (keys, h) table."""
    found = [
        sketch.lower(sketch.one_pass(base, keys, "h", prehashed=True, dedup=False), keys).select(
            F.lit(name).alias("name"), *keys, "estimate"
        )
        for name, sketch in methods.items()
    ]
    return functools.reduce(DataFrame.unionByName, found)


def accuracy_report(
    df: DataFrame, keys: Sequence[str], value: str, methods: Mapping[str, Sketch]
) -> DataFrame:
    """Long form: keys, name, estimate, exact, rel_error; the input is read once."""
    base = distinct_table(df, keys, value, methods)
    truth = base.groupBy(*keys).agg(F.count("h").alias("exact"))
    joined = equi_join(estimates_of(base, keys, methods), truth, keys, "inner")
    return joined.withColumn("rel_error", relative_error(F.col("estimate"), F.col("exact")))


def accuracy_rank(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank methods per key by estimate (largest first) and by error (smallest first)."""
    by = Window.partitionBy(*keys)
    return report.withColumns(
        {
            "rank_by_estimate": F.rank()
            .over(by.orderBy(F.col("estimate").desc()))
            .cast("long"),
            "rank_by_error": F.rank().over(by.orderBy(F.round("rel_error", 9))).cast("long"),
        }
    )


def pivot_values(df: DataFrame, key: str) -> list[str]:
    """The values of a key column, in order; refuses more than Spark pivots."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = sorted(r[0] for r in df.select(key).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{key} has more than {most} values")
    return found


def accuracy_pivot(report: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Methods as rows, one error column per key value."""
    return report.groupBy("name").pivot(key, list(values)).agg(F.first("rel_error"))


def accuracy_unpivot(wide: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    return wide.unpivot("name", list(values), key, "rel_error")
