"""Session defaults, the shared work folder, and size-checked joins."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A per-group parameter table is broadcast only up to this many rows (a few
#: MB at ~32 bytes a row); beyond it only its heavy groups are.
BROADCAST_ROW_LIMIT = 200_000


def build_session(cores: str = "*", app: str = "distinctspark") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Small shuffles feed fan-outs here; keep them spread over the cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Per-call origin tracking costs more than small plans take to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@functools.cache
def _local_work_root() -> str:
    return tempfile.mkdtemp(prefix="distinctspark-")


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    that leaves it unset falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_work_root()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique path below the shared work folder."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage reliably (the files outlive any executor) and gives the
    planner true sizes for what follows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = hadoop.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_group_params(
    rows: DataFrame,
    params: DataFrame,
    keys: Sequence[str],
    weight: str,
    how: str = "inner",
) -> DataFrame:
    """Attach one-row-per-group parameters to rows without a hot-group shuffle.

    ``params`` is written once and counted from the file footers.  A small one
    is broadcast.  Of a larger one, only the heavy groups are broadcast: those
    holding more than 1/BROADCAST_ROW_LIMIT of the total ``weight`` (their row
    count), of which there can be at most BROADCAST_ROW_LIMIT.  The rest, each
    a tiny share of the rows, go through an ordinary shuffled join.
    ``how`` is ``inner`` or ``left_semi``.  ``weight`` is dropped.
    """
    params = materialize(params, "params")
    on = list(keys)
    if not on or params.count() <= BROADCAST_ROW_LIMIT:
        return equi_join(rows, F.broadcast(params.drop(weight)), on, how)
    total = params.agg(F.sum(weight)).first()[0]
    heavy_from = total / BROADCAST_ROW_LIMIT
    heavy = params.where(F.col(weight) > heavy_from).drop(weight)
    light = params.where(F.col(weight) <= heavy_from).drop(weight)
    rest = equi_join(rows, F.broadcast(heavy.select(*on)), on, "left_anti")
    return equi_join(rows, F.broadcast(heavy), on, how).unionByName(
        equi_join(rest, light, on, how)
    )


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where NULL equals NULL, as in a group-by.

    ``how`` is inner, left, left_semi or left_anti; key columns come from ``left``.
    No keys means one group: a constant key joins the one-row table.
    """
    if not on:
        left, right = left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1))
        return left.join(right, "_one", how).drop("_one")
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in on]
    return left.join(renamed, functools.reduce(Column.__and__, same), how).drop(
        *[f"_right_{k}" for k in on]
    )
