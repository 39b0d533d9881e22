"""States that change representation, packed blocks, bias correction."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from distinctspark import approx_distinct, windowed_distinct
from distinctspark.functions.bias import LINEAR_BELOW, POINTS, bias_table
from distinctspark.operators.kmv import kmv_overlap
from distinctspark.operators.packed import BLOCK_BITS, BlockedBloom, bit_is_set
from distinctspark.operators.registers import hll_alpha, loglog_alpha_m
from distinctspark.plans.accuracy import accuracy_pivot, pivot_values
from distinctspark.plans.registry import SKETCHES, make_sketch
from distinctspark.session import materialize


def rows(spark, spec):
    """(key, v): ``n`` distinct values per key and offset."""
    parts = [spark.range(lo, lo + n).select(F.lit(k).alias("key"), F.col("id").alias("v")) for k, lo, n in spec]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def forms(state):
    found = state.groupBy("key").agg(F.max("form").alias("f"), F.min("form").alias("g"), F.count("*").alias("n"))
    return {r.key: (r.f, r.n) for r in found.collect() if r.f == r.g}


SKETCH = make_sketch("HLLP", hash="mix", p=6, sp=14)  # sparse up to 48 indexes
FEW = [("empty", 0, 1), ("small", 0, 30), ("edge", 0, 48), ("over", 0, 60), ("big", 0, 5000)]


def test_state_has_one_form_per_key_and_is_bounded(spark):
    found = forms(SKETCH.state(rows(spark, FEW), ["key"], "v"))
    assert len(found) == 5 and found["small"][0] == 0 and found["big"] == (1, 64)
    assert all(n <= 64 for _, n in found.values())


@pytest.mark.parametrize("bias", [False, True])
@pytest.mark.parametrize("left,right", [("small", "small"), ("small", "big"), ("big", "big"), ("edge", "edge")])
def test_four_case_merge_equals_one_pass(spark, left, right, bias):
    sketch = make_sketch("HLLP", hash="mix", p=6, sp=14, bias=bias)
    size = dict((k, n) for k, _, n in FEW)
    a = rows(spark, [("k", 0, size[left])])
    b = rows(spark, [("k", 20, size[right])])
    merged = sketch.merge([sketch.state(x, ["key"], "v") for x in (a, b)], ["key"])
    (form, n), = forms(merged).values()
    assert n <= 64
    whole = a.union(b)
    want = sketch.count(whole, ["key"], "v").first().estimate
    assert sketch.estimate(merged, ["key"]).first().estimate == want
    assert sketch.lower(sketch.one_pass(whole, ["key"], "v"), ["key"]).first().estimate == want
    sparse = SKETCH.one_pass(whole, ["key"], "v").count() <= 48
    assert (form == 0) == sparse


def test_no_key_column_and_empty_input(spark):
    df = rows(spark, [("k", 0, 30), ("l", 10, 3000)])
    for frame in (df, df.where("key = 'k'")):
        assert SKETCH.count(frame, [], "v").first().estimate == SKETCH.lower(SKETCH.one_pass(frame, [], "v"), []).first().estimate
    assert SKETCH.count(df.limit(0), ["key"], "v").count() == 0


@pytest.mark.parametrize("p", [4, 10])
def test_bias_table_agrees_with_simulated_registers(p):
    m, rng = 1 << p, np.random.default_rng(p)
    raw, bias = map(np.array, bias_table(p, hll_alpha(p)))
    assert len(raw) == POINTS and (np.diff(raw) > 0).all() and raw[-1] >= 5 * m
    n = raw - bias
    for share in (0.5, 1.5, 3):
        size, found = int(share * m), []
        for _ in range(1500 if p == 4 else 300):
            registers = np.zeros(m, int)
            np.maximum.at(registers, rng.integers(0, m, size), rng.geometric(0.5, size))
            found.append(hll_alpha(p) * m * m / (2.0**-registers).sum())
        error = 5 * np.std(found) / math.sqrt(len(found))
        assert abs(np.mean(found) - size - np.interp(size, n, bias)) < error


def test_bias_correction_beats_the_plain_estimate_where_it_is_biased(spark):
    """2.5 to 4 values a register, where the plain estimate is raw and too high."""
    spec = [(f"k{i}", 10_000_000 * i, 2900) for i in range(150)]
    df = materialize(rows(spark, spec[:1]).limit(0).unionByName(
        spark.range(150 * 2900).select(F.concat(F.lit("k"), (F.col("id") % 150).cast("string")).alias("key"), F.col("id").alias("v"))
    ))
    mean = {}
    for bias in (False, True):
        found = approx_distinct(df, ["key"], "v", "HLLP", p=10, sp=16, bias=bias)
        mean[bias] = found.agg(F.avg(F.col("estimate") / 2900 - 1)).first()[0]
    assert abs(mean[True]) < 0.012 < mean[False]


def test_bias_table_limits(spark):
    assert len(LINEAR_BELOW) == 15
    df = rows(spark, [("k", 0, 3000)])
    high = approx_distinct(df, ["key"], "v", "HLLP", p=19, sp=20, bias=True).first().estimate
    assert abs(high - 3000) < 30


def test_window_slices_hold_at_most_their_bound(spark):
    df = spark.range(20_000).select(
        F.timestamp_millis(F.col("id") * 10).alias("ts"), F.lit("a").alias("key"), F.col("id").alias("v")
    )
    for alg, params in (("CTE", {"tip": 100, "p": 6}), ("HLLP", {"p": 6, "sp": 14})):
        sketch = make_sketch(alg, hash="mix", **params)
        slices = sketch.combine(
            sketch.one_pass(df.withColumn("slice", F.window("ts", "20 seconds")), ["key", "slice"], "v"), ["key", "slice"]
        )
        assert slices.groupBy("key", "slice").count().agg(F.max("count")).first()[0] <= 164
        got = windowed_distinct(df, ["key"], "v", "ts", 60_000, 20_000, sketch).collect()
        want = windowed_distinct(df, ["key"], "v", "ts", 60_000, 20_000, sketch, "direct").collect()
        assert sorted((r.window.start, r.estimate) for r in got) == sorted((r.window.start, r.estimate) for r in want)


def test_packed_linear_counting_has_the_same_bits(spark):
    df = rows(spark, [("a", 0, 3000), ("b", 1000, 60_000), ("c", 5, 1)])
    plain = approx_distinct(df, ["key"], "v", "LC", hash="mix", bits=100_000)
    packed = make_sketch("LCP", hash="mix", bits=100_000)
    state = materialize(packed.state(df, ["key"], "v"))
    assert state.groupBy("key").count().agg(F.max("count")).first()[0] <= -(-100_000 // BLOCK_BITS)
    want = {r.key: r.estimate for r in plain.collect()}
    twice = packed.estimate(state.unionByName(state), ["key"])
    assert {r.key: r.estimate for r in twice.collect()} == want
    full = approx_distinct(df, ["key"], "v", "LCP", bits=64).where("key = 'b'").first()
    assert full.estimate is None


def test_bits_of_a_bitmap(spark):
    at = [0, 1, 7, 8, 9, 4000, 32767]
    packed = spark.createDataFrame([(x,) for x in at], "at long").agg(F.bitmap_construct_agg("at").alias("b"))
    probes = spark.range(0, 32768).crossJoin(packed)
    assert [r.id for r in probes.where(bit_is_set(F.col("b"), F.col("id"))).orderBy("id").collect()] == at


def test_blocked_filter_of_2_to_the_31_bits(spark):
    sketch = BlockedBloom(blocks=1 << 16, k=6)
    members = spark.range(0, 20_000, 2).withColumnRenamed("id", "v")
    state = materialize(sketch.state(members, [], "v"))
    assert state.agg(F.max("block")).first()[0] > 1 << 15  # past 2^30 bits
    probes = spark.range(20_000).withColumnRenamed("id", "v")
    kept = {r.v for r in sketch.might_contain(probes, "v", state).collect()}
    assert kept >= set(range(0, 20_000, 2)) and len(kept) < 10_010
    assert abs(sketch.estimate(state, []).first().estimate / 10_000 - 1) < 0.01


def test_blocked_filter_sizes_merges_and_saturates(spark):
    sketch = BlockedBloom.for_elements(50_000, 0.01)
    assert sketch.blocks * BLOCK_BITS >= 50_000 * 9
    df = rows(spark, [("a", 0, 40_000), ("b", 0, 10)])
    parts = [sketch.state(df.where(f"v % 2 = {i}"), ["key"], "v") for i in (0, 1)]
    merged = {r.key: r.estimate for r in sketch.estimate(sketch.merge(parts, ["key"]), ["key"]).collect()}
    assert abs(merged["a"] / 40_000 - 1) < 0.02 and merged["b"] == 10
    found = sketch.might_contain(df.selectExpr("CASE WHEN v < 50 THEN NULL ELSE v END AS v"), "v", sketch.state(df, [], "v"))
    assert found.where("v IS NULL").count() == 0 and found.count() == 39_950


def test_overlap_of_appended_states(spark):
    df = rows(spark, [("a", 0, 5000), ("b", 5000, 5000)])
    state = make_sketch("KMV", k=64).state(df, ["key"], "v")
    once = kmv_overlap(state, 64, ["key"]).first()
    twice = kmv_overlap(state.unionByName(state), 64, ["key"]).first()
    assert once == twice and twice.jaccard == 0 and twice.intersection_estimate == 0


@pytest.mark.parametrize("alg,params", [
    ("LL", {"p": 10}), ("AC", {"p": 10}), ("HLL", {"p": 10}), ("HLLP", {"p": 6, "sp": 14}), ("LC", {"bits": 4096}),
    ("LCP", {"bits": 4096}), ("FM", {"groups": 2, "hashes": 2}), ("KMV", {"k": 32}), ("BF", {"bits": 1 << 14, "k": 3}),
    ("BFB", {"blocks": 2, "k": 3}), ("BJKST", {"tries": 3}), ("CTE", {"tip": 100, "p": 8}), ("EXACT", {}),
])
def test_states_appended_twice_estimate_as_once(spark, alg, params):
    sketch = make_sketch(alg, **params)
    state = materialize(sketch.state(rows(spark, [("a", 0, 900), ("b", 0, 20)]), ["key"], "v"))
    once = sorted((r.key, r.estimate) for r in sketch.estimate(state, ["key"]).collect())
    twice = sorted((r.key, r.estimate) for r in sketch.estimate(state.unionByName(state), ["key"]).collect())
    assert once == twice and len(once) == 2


def test_given_64_bit_hashes(spark):
    df = spark.range(100_000).select(F.xxhash64("id").alias("h"))
    for alg, params in (("HLL", {"p": 14}), ("KMV", {"k": 4096})):
        found = approx_distinct(df, [], "h", alg, prehashed=64, **params).first().estimate
        assert abs(found / 100_000 - 1) < 0.05


def test_keys_of_nulls_only_count_zero(spark):
    df = rows(spark, [("a", 0, 50)]).unionByName(spark.range(3).selectExpr("'n' AS key", "CAST(NULL AS LONG) AS v"))
    for alg in sorted(SKETCHES):
        found = {r.key: r.estimate for r in approx_distinct(df, ["key"], "v", alg).collect()}
        assert found["n"] == 0 and found["a"] > 30, alg
    full = approx_distinct(df.unionByName(rows(spark, [("b", 0, 9000)])), ["key"], "v", "LC", bits=8)
    assert {r.key: r.estimate for r in full.where("key <> 'a'").collect()} == {"n": 0, "b": None}


def test_minima_are_cut_before_the_shuffle_at_any_k(spark):
    df = rows(spark, [("a", 0, 10**6)])  # only planned
    for k in (1024, 5000):
        sketch = make_sketch("KMV", k=k)
        plan = sketch.reduce(sketch.hashed(df, ["key"], "v"), ["key"])
        assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_loglog_constant_tends_to_its_limit():
    for p in range(12, 31):
        assert abs(loglog_alpha_m(p) / (1 << p) - 0.39701181) < 0.5 / (1 << p) + 1e-7


def test_pivot_takes_its_columns_from_the_data(spark):
    df = spark.createDataFrame([("m", "x", 0.1), ("m", "sixth", 0.2)], "name string, key string, rel_error double")
    wide = accuracy_pivot(df, "key", pivot_values(df, "key"))
    assert wide.columns == ["name", "sixth", "x"] and tuple(wide.first()) == ("m", 0.2, 0.1)
