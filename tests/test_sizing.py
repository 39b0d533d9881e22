import math

import pytest
from pyspark.sql import functions as F

from distinctspark.functions import sizing as S
from distinctspark.operators.bloom import bloom_sizing


def test_power_of_two_rule():
    assert [S.pow2_half(n) for n in (1, 2, 100, 108, 128, 129, 169)] == [0, 1, 64, 64, 64, 128, 128]


def test_power_of_two_rule_as_column(spark):
    df = spark.range(1, 3000).withColumn("p", S.pow2_half_column(F.col("id")))
    assert all(r.p == S.pow2_half(r.id) for r in df.collect())


@pytest.mark.parametrize("n", [1, 99, 100, 101, 999, 1000, 12345, 9_999_999, 10_000_000,
                               49_999_999, 50_000_000, 99_999_999, 119_999_999, 120_000_000,
                               120_000_001, 500_000_000])
def test_one_percent_table(spark, n):
    got = S.linear_bits_one_percent(spark.createDataFrame([(n,)], "n long"), "n").first()
    assert got.lc_bits == -(-S.one_percent_bits(n) // 8) * 8


def test_one_percent_known_points():
    assert S.one_percent_bits(50) == 5034
    assert S.one_percent_bits(1000) == 5329
    assert S.one_percent_bits(1500) == 5488  # halfway, rounded up
    assert S.one_percent_bits(120_000_000) == 10112529


@pytest.mark.parametrize("n,error", [(10, 0.1), (1000, 0.01), (1000, 0.05), (50_000, 0.02)])
def test_error_inequality(spark, n, error):
    def enough(length):
        t = n / length
        return t < 700 and length > max(1 / (error * t) ** 2, 5) * (math.exp(t) - t - 1)

    first = next(length for length in range(1, 10**6) if enough(length))
    got = spark.range(1).select(S.linear_bits_for_error(F.lit(n), error)).first()[0]
    assert got == first == S.bits_for_error(n, error)


def test_bloom_choice_prefers_fewer_bits_then_fewer_hashes(spark):
    targets = [0.9, 0.4, 0.2, 0.1, 0.05, 0.01, 0.0013, 0.0009, 0.0001]
    df = spark.createDataFrame([(t, 100) for t in targets], "target double, n long")
    got = {r.target: (r.bits_per_element, r.k, r.bits) for r in
           bloom_sizing(df, "n", "target").collect()}
    for t in targets:
        bits, k = S.bloom_spec(t)
        assert got[t] == (bits, k, 100 * bits)
    assert S.bloom_spec(0.9) == (2, 1) and S.bloom_spec(0.0001) == (15, 8)


def test_hll_log2m():
    assert [S.hll_log2m(r) for r in (0.6, 0.1, 0.02)] == [1, 6, 11]
