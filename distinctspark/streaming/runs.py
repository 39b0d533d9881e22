"""Run streams over what is available, in steps, and read back what they gave."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from distinctspark.session import new_path


def stream_session(spark: SparkSession) -> SparkSession:
    """A sibling session with the same settings, for the state partitions of a stream.

    A stateful stream fixes their number at its first start, for ever; it is
    ``spark.sql.shuffle.partitions`` as configured, so size that for the stream's later life.
    """
    session = spark.newSession()
    for key in ("spark.checkpoint.dir", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        value = spark.conf.get(key, None)
        if value and session.conf.get(key, None) != value:
            session.conf.set(key, value)
    return session


def event_time(df: DataFrame, micros: str, delay_ms: int = 0, out: str = "ts") -> DataFrame:
    """A TIMESTAMP column from epoch microseconds, with its watermark."""
    stamped = df.withColumn(out, F.timestamp_micros(micros))
    return stamped.withWatermark(out, f"{delay_ms} milliseconds")


class BatchLog(StreamingQueryListener):
    """Every micro-batch of a query as a row of a table in the shared folder.

    Spark itself remembers the last 100 batches only.  Rows wait here until FLUSH of them are written.
    """

    FLUSH = 1000
    SCHEMA = (
        "batch_id long, n_input long, rows_per_second double, trigger_ms long, "
        "watermark_ms long, n_late long, observed string"
    )

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, new_path(spark, "batches")
        self.rows: list[tuple] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows.append(batch_row(json.loads(event.progress.json)))
        if len(self.rows) >= self.FLUSH:
            self.flush()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(
            self.path
        )


def batch_row(progress: dict) -> tuple:
    """The fields of BatchLog.SCHEMA out of one progress report."""
    stamp = progress.get("eventTime", {}).get("watermark")
    mark = datetime.fromisoformat(stamp.replace("Z", "+00:00")) if stamp else None
    return (
        int(progress["batchId"]),
        int(progress["numInputRows"]),
        float(progress.get("processedRowsPerSecond") or 0.0),
        int((progress.get("durationMs") or {}).get("triggerExecution", 0)),
        round(mark.timestamp() * 1000) if mark else None,
        sum(s.get("numRowsDroppedByWatermark", 0) for s in progress.get("stateOperators", [])),
        json.dumps(progress.get("observedMetrics") or {}),
    )


@dataclass
class Drained:
    """Where a finished stream left its output, its checkpoint and the log of its batches."""

    spark: SparkSession
    output: str
    checkpoint: str
    schema: object
    log: str

    def result(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.output)

    def batches(self) -> DataFrame:
        """One row per micro-batch, of all steps."""
        return self.spark.read.schema(BatchLog.SCHEMA).parquet(self.log)

    def watermark_ms(self) -> int:
        """Event-time watermark the stream ended with, epoch ms."""
        return self.batches().agg(F.max("watermark_ms")).first()[0] or 0


def start(
    result: DataFrame,
    output: str,
    checkpoint: str,
    mode: str = "append",
    sink: str = "parquet",
    name: str | None = None,
    once: bool = True,
    interval: str | None = None,
) -> StreamingQuery:
    """Start a query.  ``parquet`` appends files; ``upsert`` keeps every batch's rows under its
    number (see :func:`latest`) and takes update mode; ``console``, ``noop`` and ``memory`` take any
    output mode and are for looking at small results.
    """
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if sink == "upsert":
        writer = writer.foreachBatch(upsert(output))
    else:
        writer = writer.format(sink)
    if sink == "parquet":
        writer = writer.option("path", output)
    if name:
        writer = writer.queryName(name)
    if once:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def upsert(output: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that may be repeated: a batch's rows replace what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return write


def latest(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows an upsert sink holds, the last version of each key."""
    others = [c for c in versions.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*others), "batch_id").alias("_newest")
    return versions.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def drain(
    spark: SparkSession,
    build: Callable[[SparkSession], DataFrame],
    feed: Callable[[int], None] | None = None,
    steps: int = 1,
    mode: str = "append",
    sink: str = "parquet",
) -> Drained:
    """Feed and run a stream step by step over one checkpoint.

    Each step makes new input available through ``feed`` and runs the query
    until that is consumed; state and watermark carry over, as across restarts.
    """
    session = stream_session(spark)
    output, checkpoint = new_path(spark, "stream-out"), new_path(spark, "stream-ckpt")
    log = BatchLog(session)
    schema = None
    session.streams.addListener(log)
    try:
        for step in range(steps):
            if feed:
                feed(step)
            result = build(session)
            schema = result.schema
            log.ended.clear()
            start(result, output, checkpoint, mode, sink).awaitTermination()
            log.ended.wait(60)  # the last reports arrive before the end is told
            log.flush()
    finally:
        session.streams.removeListener(log)
    if sink == "upsert":
        schema = StructType([*schema, StructField("batch_id", LongType())])
    return Drained(spark, output, checkpoint, schema, log.path)


def progress_table(spark: SparkSession, drained: Drained) -> DataFrame:
    """Per micro-batch throughput metrics as rows (one row per batch)."""
    return drained.batches().select("batch_id", "n_input", "rows_per_second", "trigger_ms")


def observed(drained: Drained, name: str, schema: str) -> DataFrame:
    """batch_id and the metrics that ``observe(name, ...)`` took of every batch that had rows."""
    path = f"$.{name}"
    found = F.from_json(F.get_json_object("observed", path), schema)
    return drained.batches().where("n_input > 0").select("batch_id", found.alias("m")).select("batch_id", "m.*")


def live_state(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Rows the stream still holds in its state store: windows not yet closed."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    return reader.load(checkpoint)
