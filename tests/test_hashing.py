"""Hash and bit expressions against plain Python."""

import random

from pyspark.sql import functions as F

from distinctspark.functions import hashing as H

MASK = H.HALF_MASK


def mix_python(v: int) -> int:
    high, low = (v >> 30) & MASK, v & MASK
    for i, (mul, add) in enumerate(H.MIX_ROUNDS):
        if i % 2 == 0:
            high ^= (((low + add) * mul) >> 15) & MASK
        else:
            low ^= (((high + add) * mul) >> 15) & MASK
    return (high << 30) | low


def edge_values():
    rng = random.Random(5)
    near = {max(0, (1 << i) + d) for i in range(60) for d in (-2, -1, 0, 1, 2)}
    near |= {(1 << 60) - 1 - i for i in range(50)} | {rng.getrandbits(60) for _ in range(500)}
    return sorted(v for v in near if v < 1 << 60)


def test_mix_matches_python_and_is_injective(spark):
    values = edge_values()
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = {r.x: r.h for r in df.select("x", H.hash60("x", "mix").alias("h")).collect()}
    assert got == {v: mix_python(v) for v in values}
    assert len(set(got.values())) == len(values)


def test_bit_ranks(spark):
    values = edge_values()
    df = spark.createDataFrame([(v,) for v in values], "x long").select(
        "x",
        H.leading_rank(F.col("x"), 60).alias("lead"),
        H.trailing_zeros(F.col("x")).alias("trail"),
        H.lowest_unset_bit(F.col("x")).alias("unset"),
    )
    for r in df.collect():
        assert r.lead == 61 - r.x.bit_length()
        assert r.trail == ((r.x & -r.x).bit_length() - 1 if r.x else 60)
        assert r.unset == (~r.x & (r.x + 1)).bit_length() - 1


def test_all_kinds_stay_in_60_bits(spark):
    df = spark.range(2000)
    for kind in H.HASH_KINDS:
        low, high, n = (
            df.select(H.hash60("id", kind).alias("h"))
            .agg(F.min("h"), F.max("h"), F.count_distinct("h"))
            .first()
        )
        assert 0 <= low and high < 1 << 60 and n == 2000


def test_seeded_family_matches_python(spark):
    rows = H.with_seeds(spark.createDataFrame([(v,) for v in edge_values()[:50]], "h long"), 4)
    for r in rows.withColumn("s", H.seeded_hash()).collect():
        hi, lo = r.h >> 30, r.h & MASK
        a, b, c, d, e, f = H.family_coefficients(r.seed)
        first = (a * hi + b * lo + c) % H.PRIME & MASK
        second = (d * hi + e * lo + f) % H.PRIME & MASK
        assert r.s == (first << 30) | second


def test_bloom_positions(spark):
    df = spark.createDataFrame([(v,) for v in edge_values()[:50]], "h long")
    for r in df.withColumn("p", H.bloom_positions(F.col("h"), 5, 1009)).collect():
        assert r.p == [((r.h >> 30) + i * (r.h & MASK)) % 1009 for i in range(5)]
