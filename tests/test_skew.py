"""One key, or one value, holding a third of the rows; and the large-side join paths."""

import pytest
from pyspark.sql import functions as F

from distinctspark import make_sketch
from distinctspark import session as sess
from distinctspark.operators.linear import linear_counting_sized
from distinctspark.operators.ordered import cumulative_share, mean_and_median
from tests.test_sketches import ALL


def skewed(spark, n=30000):
    """A third of the rows in key 0, another third the same value."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, F.lit(0)).otherwise(1 + i % 50).cast("int").alias("key"),
        F.when(i % 3 == 1, F.lit(7)).otherwise(i).cast("long").alias("value"),
    )


def truth(df):
    return {r.key: r.n for r in df.groupBy("key").agg(F.count_distinct("value").alias("n"))
            .collect()}


@pytest.mark.parametrize("alg", ALL)
def test_hot_key_and_hot_value(spark, alg):
    df = skewed(spark)
    exact = truth(df)
    found = make_sketch(alg, **ALL[alg]).count(df, ["key"], "value").collect()
    assert {r.key for r in found} == set(exact)
    if alg == "EXACT":
        assert {r.key: r.estimate for r in found} == exact


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_parameter_join_paths_agree(spark, monkeypatch, limit):
    df = skewed(spark)
    params = df.groupBy("key").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    want = sorted(map(tuple, df.join(params.drop("n"), "key").collect()))
    monkeypatch.setattr(sess, "BROADCAST_ROW_LIMIT", max(limit, 1))
    got = sess.join_group_params(df, params, ["key"], weight="n")
    assert sorted(map(tuple, got.select("key", "value", "top").collect())) == want


def test_sized_linear_counting_on_both_join_paths(spark, monkeypatch):
    df = skewed(spark)
    want = sorted(map(tuple, linear_counting_sized(df, ["key"], "value").collect()))
    monkeypatch.setattr(sess, "BROADCAST_ROW_LIMIT", 5)
    assert sorted(map(tuple, linear_counting_sized(df, ["key"], "value").collect())) == want


@pytest.mark.parametrize("alg", ["BJKST", "CTE"])
def test_bounded_states_on_the_shuffled_path(spark, monkeypatch, alg):
    df = skewed(spark, 6000)
    sketch = make_sketch(alg, **ALL[alg])
    want = sorted(map(tuple, sketch.state(df, ["key"], "value").collect()))
    monkeypatch.setattr(sess, "BROADCAST_ROW_LIMIT", 4)
    assert sorted(map(tuple, sketch.state(df, ["key"], "value").collect())) == want


def test_median_and_mean_by_selection(spark):
    df = skewed(spark)
    want = {r.key: (r.n, r.mean, r.median) for r in df.groupBy("key").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.expr("percentile(value, 0.5)").alias("median")).collect()}
    for r in mean_and_median(df, ["key"], "value").collect():
        n, mean, median = want[r.key]
        assert r.n == n and abs(r["mean"] - mean) < 1e-6 and r.median == median


def test_cumulative_share_of_a_hot_group(spark):
    df = skewed(spark).withColumn("w", F.lit(2).cast("long"))
    got = cumulative_share(df, ["key"], "value", "w").collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.key, []).append((r.value, r.w, r.cdf))
    totals = {r.key: r.t for r in df.groupBy("key").agg(F.sum("w").alias("t")).collect()}
    for key, rows in by_key.items():
        running = 0
        for _, w, cdf in sorted(rows):
            running += w
            assert abs(cdf - running / totals[key]) < 1e-12
        assert running == totals[key]


@pytest.mark.parametrize("alg", ALL)
def test_null_keys_are_a_group(spark, alg):
    df = skewed(spark, 3000).withColumn("key", F.nullif("key", F.lit(0)))
    sketch = make_sketch(alg, **ALL[alg])
    found = sketch.count(df, ["key"], "value").collect()
    assert len(found) == 51 and any(r.key is None for r in found)
    state = sketch.state(df, ["key"], "value")
    merged = sketch.estimate(sketch.merge([state, state], ["key"]), ["key"]).collect()
    pairs = [sorted((str(r.key), r.estimate) for r in rows) for rows in (found, merged)]
    assert pairs[0] == pairs[1]


def test_null_keys_in_medians(spark):
    df = skewed(spark, 3000).withColumn("key", F.nullif("key", F.lit(0)))
    assert mean_and_median(df, ["key"], "value").where("key IS NULL").first().n == 1000
