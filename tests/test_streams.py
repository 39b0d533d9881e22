"""Streams: late rows, update mode, closing, sinks; on small files."""

import pytest
from pyspark.sql import functions as F

from distinctspark import windowed_distinct
from distinctspark.session import new_path
from distinctspark.sources import events as ev
from distinctspark.streaming import runs


def feeder(spark, path, batches):
    def feed(step):
        rows = spark.createDataFrame(batches[step], "ts_ms long, key string, value string")
        rows.coalesce(1).write.mode("append").option("header", "false").csv(path)

    return feed


def build_count(path, delay="0 seconds"):
    def build(session):
        source = ev.stream_events(session, path).withWatermark("ts", delay)
        return windowed_distinct(source, ["key"], "value", "ts", 1000, 500, "EXACT")

    return build


def rows_of(df):
    return sorted(
        (r.key, round(r.window.start.timestamp() * 1000), r.estimate) for r in df.collect()
    )


FIRST = [(1000, "a", "1"), (1200, "a", "1"), (1300, "a", "2"), (2600, "a", "3")]


def test_each_window_comes_out_once_and_late_rows_are_dropped(spark):
    path = new_path(spark, "in")
    late = [(1100, "a", "9"), (4200, "a", "5")]  # 1100 is behind the watermark 2600
    drained = runs.drain(spark, build_count(path), feeder(spark, path, [FIRST, late]), 2)
    assert drained.watermark_ms() == 4200
    assert rows_of(drained.result()) == [
        ("a", 500, 2), ("a", 1000, 2), ("a", 2000, 1), ("a", 2500, 1),
    ]


def test_lateness_keeps_windows_open(spark):
    path = new_path(spark, "in")
    late = [(1100, "a", "9"), (6200, "a", "5")]
    drained = runs.drain(
        spark, build_count(path, "2 seconds"), feeder(spark, path, [FIRST, late]), 2
    )
    assert drained.watermark_ms() == 4200
    assert rows_of(drained.result())[:2] == [("a", 500, 3), ("a", 1000, 3)]


def test_update_mode_refires_live_windows(spark):
    path = new_path(spark, "in")
    feed = feeder(spark, path, [FIRST[:2], [(1250, "a", "4")]])
    session = runs.stream_session(spark)
    checkpoint = new_path(spark, "ckpt")
    seen = []
    for step in range(2):
        feed(step)
        source = ev.stream_events(session, path).withWatermark("ts", "10 seconds")
        counts = source.groupBy(F.window("ts", "1 second"), "key").agg(
            F.count("*").alias("n"), F.approx_count_distinct("value").alias("d")
        )
        query = runs.start(counts, "", checkpoint, mode="update", sink="noop")
        query.awaitTermination()
        live = runs.live_state(spark, checkpoint)
        seen.append(sorted((r.key.key, r.value["count"]) for r in live.collect()))
    assert seen == [[("a", 2)], [("a", 3)]]


def test_console_sink_and_progress(spark, capfd):
    path = new_path(spark, "in")
    feeder(spark, path, [FIRST])(0)
    session = runs.stream_session(spark)
    query = runs.start(build_count(path)(session), "", new_path(spark, "ckpt"), sink="console")
    query.awaitTermination()
    drained = runs.drain(spark, build_count(path), None, 1)
    progress = runs.progress_table(spark, drained)
    assert progress.agg(F.sum("n_input")).first()[0] == len(FIRST)


def test_bounded_intake(spark):
    path = new_path(spark, "in")
    feed = feeder(spark, path, [FIRST[:2], FIRST[2:]])
    feed(0), feed(1)

    def build(session):
        source = ev.stream_events(session, path, files_per_trigger=1)
        return source.select("key", "value")

    drained = runs.drain(spark, build)
    assert drained.result().count() == 4
    assert drained.batches().where("n_input > 0").count() == 2


def test_dedup_within_watermark(spark):
    path = new_path(spark, "in")
    rows = FIRST + FIRST[:2]

    def build(session):
        source = ev.stream_events(session, path).withWatermark("ts", "1 minute")
        return source.dropDuplicatesWithinWatermark(["key", "value"]).select("key", "value")

    drained = runs.drain(spark, build, feeder(spark, path, [rows]), 1)
    assert sorted(map(tuple, drained.result().collect())) == [("a", 100), ("a", 200), ("a", 300)]


def test_event_time_from_micros_with_a_small_delay(spark):
    path = new_path(spark, "in")

    def build(session):
        source = ev.stream_events(session, path).withColumn("us", F.unix_micros("ts"))
        timed = runs.event_time(source, "us", delay_ms=10, out="at")
        return timed.groupBy(F.window("at", "1 second"), "key").agg(F.count("*").alias("n"))

    drained = runs.drain(spark, build, feeder(spark, path, [FIRST]), 1)
    assert drained.watermark_ms() == 2590
    assert [r.n for r in drained.result().collect()] == [3]


def test_synthetic_stream_is_one_key(spark):
    made = ev.synthetic_stream(spark, 100)
    assert made.isStreaming and made.columns == ["ts", "key", "value"]


@pytest.mark.parametrize("alg,params", [
    ("LL", {"p": 5}), ("AC", {"p": 5}), ("HLLP", {"p": 5, "sp": 8}), ("LC", {"bits": 64}),
    ("FM", {}), ("BF", {"bits": 256, "k": 2}), ("CTE", {"tip": 2, "p": 5}),
])
def test_stream_equals_batch_for_every_streaming_method(spark, alg, params):
    path = new_path(spark, "in")
    rows = [(1000 + 90 * i, "ab"[i % 2], str(i * i % 17)) for i in range(60)]

    def build(session):
        source = ev.stream_events(session, path).withWatermark("ts", "0 seconds")
        return windowed_distinct(source, ["key"], "value", "ts", 1000, 500, alg, **params)

    drained = runs.drain(spark, build, feeder(spark, path, [rows]), 1)
    batch = windowed_distinct(
        ev.read_events(spark, path), ["key"], "value", "ts", 1000, 500, alg, **params
    ).where(F.unix_millis("window.end") <= drained.watermark_ms())
    got = rows_of(drained.result())
    assert got and got == rows_of(batch)
