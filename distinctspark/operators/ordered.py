"""Running sums and exact medians that do not put a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distinctspark.session import equi_join, materialize


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, weight: str, out: str = "running"
) -> DataFrame:
    """Per distinct (keys, order): summed weight, running total, group total.

    Equal order values are summed first (a balanced, map-side combined shuffle),
    so that the range partitioning that follows can split any group: its parts
    are ordered, each part is summed within one task, and the parts' totals (one
    row per part and key) give every part its offset.
    """
    summed = df.groupBy(*keys, order).agg(F.sum(weight).alias(weight))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        summed.repartitionByRange(parts, *keys, order).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranged",
    )
    totals = ranged.groupBy(*keys, "_part").agg(F.sum(weight).alias("_part_total"))
    before = Window.partitionBy(*keys).orderBy("_part")
    offsets = totals.select(
        *keys,
        "_part",
        (F.sum("_part_total").over(before) - F.col("_part_total")).alias("_offset"),
        F.sum("_part_total").over(Window.partitionBy(*keys)).alias("total"),
    )
    within = Window.partitionBy(*keys, "_part").orderBy(order)
    running = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0))
    joined = equi_join(ranged.withColumn("_within", running), offsets, [*keys, "_part"], "inner")
    return joined.withColumn(out, F.col("_within") + F.col("_offset")).drop(
        "_part", "_within", "_offset"
    )


def cumulative_share(df: DataFrame, keys: Sequence[str], order: str, weight: str) -> DataFrame:
    """Cumulative distribution of ``weight`` along ``order`` (ties share a row)."""
    totals = running_total(df, keys, order, weight)
    return totals.withColumn("cdf", F.col("running") / F.col("total")).drop("running", "total")


def mean_and_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and exact median per key, by selection over running counts."""
    exact = isinstance(df.schema[value].dataType, T.IntegralType)
    # Sums of products of integers can pass 64 bits.
    wide = F.col(value).cast("decimal(20,0)" if exact else "double")
    counted = df.where(F.col(value).isNotNull()).withColumn("_n", F.lit(1).cast("long"))
    ranks = running_total(counted, keys, value, "_n")
    first_rank = F.col("running") - F.col("_n") + 1
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1

    def at(rank):
        return F.max(
            F.when((first_rank <= rank) & (rank <= F.col("running")), F.col(value))
        )

    return (
        ranks.groupBy(*keys)
        .agg(
            F.sum("_n").alias("n"),
            F.sum((wide * F.col("_n")).cast("decimal(38,0)" if exact else "double")).alias("_sum"),
            at(low).alias("_low"),
            at(high).alias("_high"),
        )
        .select(
            *keys,
            "n",
            (F.col("_sum").cast("double") / F.col("n")).alias("mean"),
            (F.col("_low") / F.lit(2.0) + F.col("_high") / F.lit(2.0)).alias("median"),
        )
    )
