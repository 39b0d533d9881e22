"""Windowed counts: sliced = direct, against brute force, for every method."""

import pytest
from pyspark.sql import functions as F

from distinctspark import windowed_distinct
from distinctspark.plans.windows import project_result
from tests.test_sketches import ALL


def stream_rows(spark, n=400):
    """Events 37 ms apart with a few equal times."""
    return spark.range(n).select(
        (F.col("id") % 3).alias("key"),
        (F.col("id") * 7 % 90).alias("value"),
        F.timestamp_millis((F.floor(F.col("id") / 2) * 37).cast("long")).alias("ts"),
    )


def ms(t):
    return round(t.timestamp() * 1000)


def brute(df, size, slide):
    out = {}
    for r in df.collect():
        t = ms(r.ts)
        start = t // slide * slide
        while start > t - size:
            out.setdefault((r.key, start), []).append((r.value, t))
            start -= slide
    return out


@pytest.mark.parametrize("size,slide", [(1000, 500), (2, 1), (1000, 1000), (1000, 300)])
@pytest.mark.parametrize("strategy", ["direct", "sliced"])
def test_exact_windows_against_brute_force(spark, size, slide, strategy):
    df = stream_rows(spark, 120)
    got = windowed_distinct(
        df, ["key"], "value", "ts", size, slide, "EXACT", strategy, metadata=True
    )
    want = brute(df, size, slide)
    rows = {(r.key, ms(r.window.start)): r for r in got.collect()}
    assert set(rows) == set(want)
    for k, items in want.items():
        r = rows[k]
        assert r.estimate == len({v for v, _ in items})
        assert r.n_items == len(items)
        assert (ms(r.first_ts), ms(r.last_ts)) == (min(t for _, t in items),
                                                   max(t for _, t in items))
        assert ms(r.window.end) - ms(r.window.start) == size


@pytest.mark.parametrize("alg", ALL)
@pytest.mark.parametrize("metadata", [False, True])
def test_sliced_equals_direct(spark, alg, metadata):
    df = stream_rows(spark)
    results = []
    for strategy in ("direct", "sliced"):
        got = windowed_distinct(
            df, ["key"], "value", "ts", 1000, 500, alg, strategy, metadata, **ALL[alg]
        )
        assert project_result(got, ["key"]).columns == ["window", "key", "estimate"]
        columns = ["key", "window", "estimate"]
        columns += ["n_items", "first_ts", "last_ts"] if metadata else []
        results.append(sorted(map(tuple, got.select(*columns).collect())))
    assert results[0] == results[1]
    if metadata:
        counts = {(k, ms(w.start)): n for k, w, _, n, _, _ in results[0]}
        assert counts == {k: len(v) for k, v in brute(df, 1000, 500).items()}


@pytest.mark.parametrize("size,slide", [(1000, 500), (2, 1), (1000, 1000), (1000, 300), (300, 900)])
def test_interval_counts_against_brute_force(spark, size, slide):
    df = stream_rows(spark, 300)
    got = windowed_distinct(df, ["key"], "value", "ts", size, slide, "EXACT", "intervals")
    want = brute(df, size, slide)
    counts = {(r.key, ms(r.window.start)): r.estimate for r in got.collect()}
    assert counts == {k: len({v for v, _ in items}) for k, items in want.items()}


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="unknown strategy"):
        windowed_distinct(stream_rows(spark), ["key"], "value", "ts", 10, 5, strategy="lazy")
