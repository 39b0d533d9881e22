"""Bounded sketches in stream state: against the batch operators, late rows, update mode."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from distinctspark import windowed_distinct
from distinctspark.operators.base import Sketch
from distinctspark.plans.registry import make_sketch
from distinctspark.session import new_path
from distinctspark.sources import events as ev
from distinctspark.streaming import runs
from distinctspark.streaming.buffers import BUFFERS, Tipping, bit_length, buffered_windows
from distinctspark.streaming.buffers import trailing_zeros as zeros

SKETCHES = [
    ("KMV", {"k": 20}),
    ("BJKST", {"tries": 3, "set_size": 3, "error": 0.4}),
    ("BJKST", {"tries": 4, "set_size": 2, "error": 0.4, "combine_by": "vote"}),
    ("BJKST", {"error": 0.9}),
    ("CTE", {"tip": 30, "p": 8}),
    ("CTE", {"tip": 30, "p": 8, "estimator": "HLL"}),
    ("CTE", {"tip": 0, "p": 6, "estimator": "LC"}),
    ("CTE", {"tip": 30, "p": 8, "estimator": "LL"}),
]


def sketch_of(alg, params) -> Sketch:
    params = dict(params)
    return make_sketch(alg, hash="mix", error=params.pop("error", None), **params)


def feeder(spark, path, batches):
    def feed(step):
        rows = spark.createDataFrame(batches[step], "ts_ms long, key string, value string")
        rows.write.mode("append").option("header", "false").csv(path)

    return feed


def made(n, start, span, seed):
    rng = np.random.default_rng(seed)
    ts = start + np.sort(rng.integers(0, span, n))
    return [(int(t), "ab"[i % 3 == 0], str(int(rng.integers(0, 400)))) for i, t in enumerate(ts)]


@pytest.mark.parametrize("alg,params", SKETCHES)
def test_stream_equals_batch(spark, alg, params):
    path, sketch = new_path(spark, "in"), sketch_of(alg, params)
    steps = [made(700, 0, 5000, 1), made(500, 5000, 5000, 2)]

    def build(session):
        source = ev.stream_events(session, path).withWatermark("ts", "0 seconds")
        return windowed_distinct(source, ["key"], "value", "ts", 2000, 1000, sketch, metadata=True)

    drained = runs.drain(spark, build, feeder(spark, path, steps), 2)
    got = {(r.key, r.window.start): (r.estimate, r.n_items, r.first_ts, r.last_ts) for r in drained.result().collect()}
    rows = ev.read_events(spark, path)
    want = windowed_distinct(rows, ["key"], "value", "ts", 2000, 1000, sketch, "direct").collect()
    counts = {
        (r.key, r.window.start): (r.n, r.first, r.last)
        for r in rows.groupBy("key", F.window("ts", "2 seconds", "1 second"))
        .agg(F.count("value").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        .collect()
    }
    end = drained.watermark_ms()
    closed = {
        (r.key, r.window.start): (r.estimate, *counts[r.key, r.window.start])
        for r in want
        if r.window.end.timestamp() * 1000 <= end
    }
    assert got == closed and len(closed) >= 16


@pytest.mark.parametrize("alg,params", SKETCHES)
def test_state_stays_within_its_bound(alg, params):
    sketch = sketch_of(alg, params)
    buffer, rng = BUFFERS[alg](sketch), np.random.default_rng(4)
    for _ in range(20):
        buffer.add(rng.integers(0, 1 << 60, 500))
        buffer = BUFFERS[alg](sketch, buffer.pack())  # as the state store keeps it
    bound = {"KMV": 8 * 20, "CTE": 1 + max(8 * 30, 256)}.get(alg)
    if alg == "BJKST":
        bound = 8 * sketch.tries * (sketch.buffer + 2)
    assert len(buffer.pack()) <= bound
    assert buffer.result()[4] > 0


def test_order_and_batches_do_not_matter():
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 60, 3000)
    for alg, params in SKETCHES:
        results = set()
        for parts in (1, 7, 100):
            buffer = BUFFERS[alg](sketch_of(alg, params))
            for part in np.array_split(rng.permutation(np.r_[hashes, hashes[:500]]), parts):
                buffer.add(part)
            results.add(buffer.result())
        assert len(results) == 1


def test_bits_of_wide_hashes():
    x = np.array([0, 1, 2, (1 << 59) - 1, 1 << 59, (1 << 60) - 1, 3 << 40], np.int64)
    assert bit_length(x).tolist() == [int(v).bit_length() for v in x]
    assert zeros(x).tolist() == [60, 0, 1, 0, 59, 0, 40]
    buffer = Tipping(make_sketch("CTE", tip=0, p=4))
    buffer.add(np.array([(1 << 56) - 1, 5 << 56], np.int64))
    assert buffer.held[0] == 1 and buffer.held[5] == 57


FIRST = [(1000, "a", "1"), (1200, "a", "1"), (1300, "a", "2"), (2600, "a", "3")]


def test_late_rows_are_dropped_and_counted(spark):
    path = new_path(spark, "in")
    late = [(1100, "a", "9"), (1150, "a", "8"), (4200, "a", "5")]

    def build(session):
        source = ev.stream_events(session, path).withWatermark("ts", "10 milliseconds")
        return windowed_distinct(source, ["key"], "value", "ts", 1000, None, "KMV")

    drained = runs.drain(spark, build, feeder(spark, path, [FIRST, late]), 2)
    found = sorted((r.window.start.timestamp(), r.estimate) for r in drained.result().collect())
    assert found == [(1.0, 2), (2.0, 1)]
    assert drained.batches().agg(F.sum("n_late"), F.sum("n_input")).first()[:] == (2, 7)
    assert drained.watermark_ms() == 4190


def test_update_mode_fires_again_and_keeps_the_newest(spark):
    path = new_path(spark, "in")

    def build(session):
        source = ev.stream_events(session, path).withWatermark("ts", "10 seconds")
        return windowed_distinct(source, ["key"], "value", "ts", 1000, None, "CTE", metadata=True,
                                 output_mode="update", tip=2)

    feed = feeder(spark, path, [FIRST, [(1100, "a", "9"), (2700, "b", "1")]])
    drained = runs.drain(spark, build, feed, 2, mode="update", sink="upsert")
    versions = drained.result()
    fired = versions.where("key = 'a'").groupBy("window.start").count().collect()
    assert sorted(r["count"] for r in fired) == [1, 2]
    newest = runs.latest(versions, ["window", "key"])
    assert sorted((r.key, r.n_items) for r in newest.collect()) == [("a", 1), ("a", 4), ("b", 1)]
    exact = {r.estimate for r in newest.where("n_items = 1").collect()}
    assert exact == {1}


def test_a_repeated_batch_replaces_itself(spark):
    path = new_path(spark, "upsert")
    write = runs.upsert(path)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n long")
    write(rows, 0), write(rows, 0), write(rows.where("key = 'a'").selectExpr("key", "n + 5 AS n"), 1)
    assert spark.read.parquet(path).count() == 3
    found = runs.latest(spark.read.parquet(path), ["key"]).collect()
    assert sorted(map(tuple, found)) == [("a", 6), ("b", 2)]


def test_more_batches_than_spark_remembers(spark):
    path = new_path(spark, "in")
    rows = [[(1000 + 10 * i, "a", str(i))] for i in range(6)]
    for step in range(6):
        feeder(spark, path, rows)(step)

    def build(session):
        session.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
        source = ev.stream_events(session, path, files_per_trigger=1)
        return source.observe("seen", F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select("key")

    drained = runs.drain(spark, build)
    found = runs.observed(drained, "seen", "n long, top long")
    assert found.agg(F.sum("n"), F.max("top")).first()[:] == (6, 500) and found.count() == 6


def test_dedup_forgets_after_the_watermark(spark):
    path = new_path(spark, "in")
    steps = [[(1000, "a", "1"), (1500, "a", "1")], [(9000, "a", "2")], [(9500, "a", "1"), (9600, "a", "2")]]

    def build(session):
        source = ev.stream_events(session, path).withWatermark("ts", "2 seconds")
        return source.dropDuplicatesWithinWatermark(["key", "value"]).select("key", "value", "ts_ms")

    drained = runs.drain(spark, build, feeder(spark, path, steps), 3)
    found = sorted((r.value, r.ts_ms) for r in drained.result().collect())
    assert [v for v, _ in found] == [100, 100, 200] and found[1] == (100, 9500)


def test_no_keys_and_wrong_modes(spark):
    path = new_path(spark, "in")
    feeder(spark, path, [FIRST])(0)

    def build(session):
        source = ev.stream_events(session, path).withWatermark("ts", "0 seconds")
        return windowed_distinct(source, [], "value", "ts", 1000, None, "KMV")

    assert [r.estimate for r in runs.drain(spark, build).result().collect()] == [2]
    source = ev.stream_events(spark, path).withWatermark("ts", "0 seconds")
    with pytest.raises(ValueError, match="no update mode"):
        windowed_distinct(source, ["key"], "value", "ts", 1000, 500, "HLL", output_mode="update")
    with pytest.raises(ValueError, match="no buffer"):
        buffered_windows(source, ["key"], "ts", "1 second", "1 second", make_sketch("HLL"))
