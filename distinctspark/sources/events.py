"""Event records: (ts epoch ms, key, value), as header-less CSV or synthetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("ts_ms", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
#: Values are decimals; they are kept as integers of this fraction.
VALUE_SCALE = 100
MISSING_KEY = "DUMMY"
SYNTHETIC_KEY = "h1"


def _csv_options(comment: str | None) -> dict[str, str]:
    return {"header": "false", "mode": "PERMISSIVE"} | ({"comment": comment} if comment else {})


def read_raw(spark: SparkSession, path: str, comment: str | None = "*") -> DataFrame:
    """The positional text fields of header-less CSV files."""
    return spark.read.schema(RAW_SCHEMA).options(**_csv_options(comment)).csv(path)


def read_events(spark: SparkSession, path: str, comment: str | None = "*") -> DataFrame:
    """ts_ms, ts, key, value of header-less CSV files; short rows keep NULLs.

    Rows without a time are dropped; :func:`rejected_rows` of :func:`read_raw` counts them.
    """
    return parse_events(read_raw(spark, path, comment))


def stream_events(
    spark: SparkSession,
    path: str,
    comment: str | None = "*",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The same as an event-time stream; ``files_per_trigger`` bounds the intake rate."""
    reader = spark.readStream.schema(RAW_SCHEMA).options(**_csv_options(comment))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_events(reader.csv(path))


def parse_events(raw: DataFrame) -> DataFrame:
    """Cast the positional text fields; what does not parse becomes NULL."""
    ms = F.col("ts_ms").try_cast("long")
    return raw.select(
        ms.alias("ts_ms"),
        F.timestamp_millis(ms).alias("ts"),
        F.col("key"),
        scaled_value(F.col("value").try_cast("double")).alias("value"),
    ).where(F.col("ts_ms").isNotNull())


def rejected_rows(raw: DataFrame) -> DataFrame:
    """n_rows, and how many of the positional text rows lack a time, a key or a value.

    ``bad`` fields are there but do not parse; a row may count in several columns.
    """
    bad_ts = F.col("ts_ms").try_cast("long").isNull()
    bad_value = F.col("value").isNotNull() & F.col("value").try_cast("double").isNull()
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad_ts).alias("n_dropped"),
        F.count_if(F.col("key").isNull()).alias("n_no_key"),
        F.count_if(F.col("value").isNull()).alias("n_no_value"),
        F.count_if(bad_value).alias("n_bad_value"),
    )


def scaled_value(value: Column) -> Column:
    return F.round(value * VALUE_SCALE).cast("long")


def write_events(events: DataFrame, path: str) -> None:
    """(ts_ms, key, value) rows as header-less CSV."""
    events.select("ts_ms", "key", "value").write.option("header", "false").csv(path)


def fill_missing(events: DataFrame, seed: int = 0) -> DataFrame:
    """Rows without key or value get the dummy key and a normal value around 2000."""
    short = F.col("key").isNull() | F.col("value").isNull()
    drawn = F.round((F.randn(seed) * 5 + 20) * VALUE_SCALE).cast("long")
    return events.withColumns(
        {
            "value": F.when(short, drawn).otherwise(F.col("value")),
            "key": F.when(short, F.lit(MISSING_KEY)).otherwise(F.col("key")),
        }
    )


def limit_duration(events: DataFrame, ts: str, duration: Column) -> DataFrame:
    """Rows with ts <= first ts + duration.

    The first timestamp is one scalar fetched up front, so that the cut is a
    literal predicate the scan can push down to row-group statistics.
    """
    # As text, so that no client-side time zone takes part.
    first = events.agg(F.min(ts).cast("string")).first()[0]
    if first is None:
        return events
    last = F.lit(first).cast(events.schema[ts].dataType) + duration
    return events.where(F.col(ts) <= last)


def synthetic_events(
    ticks: DataFrame, tick: str, ts: str, seed: int = 0, per_tick: int = 5
) -> DataFrame:
    """``per_tick`` repeatable pseudo-random values for every tick, all of one key."""
    rows = ticks.select(
        F.col(ts).alias("ts"), F.col(tick).alias("tick"), F.explode(_copies(per_tick)).alias("i")
    )
    value = F.xxhash64(F.lit(seed), "tick", "i")
    return rows.select("ts", F.lit(SYNTHETIC_KEY).alias("key"), value.alias("value"))


def synthetic_stream(
    spark: SparkSession, ticks_per_second: int, seed: int = 0, per_tick: int = 5
) -> DataFrame:
    """The same from Spark's rate source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", ticks_per_second).load()
    return synthetic_events(ticks, "value", "timestamp", seed, per_tick)


def _copies(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))
