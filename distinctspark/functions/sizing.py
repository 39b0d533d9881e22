"""Sizing rules: how large a sketch must be for an error target.

Each rule exists for plain numbers (sketch parameters) and, where a table of
targets makes sense, as a column expression or a DataFrame transformation.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bits of a linear counter that keeps 1 % error, by maximum
# cardinality.  Entry i of a decade starting at 10^d is for (i+1)*10^d.
ONE_PERCENT_BITS = {
    100: (5034, 5067, 5100, 5133, 5166, 5199, 5231, 5264, 5296),
    1_000: (5329, 5647, 5957, 6260, 6556, 6847, 7132, 7412, 7688),
    10_000: (7960, 10506, 12839, 15036, 17134, 19156, 21117, 23029, 24897),
    100_000: (26729, 43710, 59264, 73999, 88175, 101932, 115359, 128514, 141441),
    1_000_000: (154171, 274328, 386798, 494794, 599692, 702246, 802931, 902069, 999894),
}
# The same above ten million, (cardinality, bits).
ONE_PERCENT_TAIL = (
    (10_000_000, 1096582),
    (50_000_000, 4584297),
    (100_000_000, 8571013),
    (120_000_000, 10112529),
)

# Best number of hash functions for 0, 1, 2, ... bits per element.
BEST_K = (1, 1, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8, 8, 9, 10, 10, 11, 12, 12, 13, 14)

#: Range of bits per element the Bloom sizing searches, and the K it settles
#: for when no choice in that range meets the target.
BLOOM_MIN_BITS, BLOOM_MAX_BITS, BLOOM_MAX_K = 2, 15, 8

#: Upper end of the linear-counter length search.
LC_SEARCH_STEPS = 61


def pow2_half(n: int) -> int:
    """Half of the smallest power of two not below ``n``."""
    return (1 << max(0, math.ceil(math.log2(n)))) // 2 if n > 1 else 0


def loglog_registers(error: float) -> int:
    return pow2_half(int((1.30 / error) ** 2))


def hll_registers(error: float) -> int:
    return pow2_half(int((1.04 / error) ** 2))


def fm_hashes(error: float) -> int:
    return pow2_half(int((1 / error) ** 2))


def kmv_k(error: float) -> int:
    return pow2_half(int(2 + 2 / (math.pi * error * error)))


def bjkst_buffer(error: float, set_size: int = 576) -> int:
    return int(set_size / error**2)


def hll_log2m(rsd: float) -> int:
    return int(math.log2((1.106 / rsd) ** 2))


def pow2_half_column(n: Column) -> Column:
    """Column form of :func:`pow2_half`, exact for 1 <= n < 2^53."""
    digits = F.length(F.bin(n.cast("long") - 1))
    power = F.call_function("shiftleft", F.lit(1).cast("long"), digits - 1)
    return F.when(n > 1, power).otherwise(
        F.lit(0).cast("long")
    )


def sizes_for_error(error: Column) -> dict[str, Column]:
    """The power-of-two sizes of every error-parameterised sketch."""
    return {
        "loglog_m": pow2_half_column(F.floor(F.pow(1.30 / error, F.lit(2)))),
        "hll_m": pow2_half_column(F.floor(F.pow(1.04 / error, F.lit(2)))),
        "fm_hashes": pow2_half_column(F.floor(F.pow(1.0 / error, F.lit(2)))),
        "kmv_k": pow2_half_column(F.floor(2 + 2 / (F.lit(math.pi) * error * error))),
        "bjkst_buffer": F.floor(576 / (error * error)),
        "hll_log2m": F.floor(F.log2(F.pow(1.106 / error, F.lit(2)))),
    }


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear interpolation, rounded up."""
    return F.ceil(y0 + (x - x0) * (y1 - y0).cast("double") / (x1 - x0))


def literal_table(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """A small constant table, planned as a local relation."""
    values = ", ".join(f"({', '.join(map(str, row))})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def one_percent_breakpoints(spark: SparkSession) -> DataFrame:
    """The 1 % table as rows (lo, hi, bits_lo, bits_hi); 48 rows, fixed."""
    points = _one_percent_points()
    rows = [
        (lo, hi, y0, y1) for (lo, y0), (hi, y1) in zip(points[:-1], points[1:], strict=True)
    ]
    return literal_table(spark, rows, "lo", "hi", "bits_lo", "bits_hi")


def one_percent_lower_bound(n: Column) -> Column:
    """The breakpoint at or below ``n``: turns the range lookup into an equi-join."""
    scale = F.pow(F.lit(10.0), F.length(n.cast("string")) - 1).cast("long")
    return (
        F.when(n < 10_000_000, F.expr("0L") + F.floor(n / scale) * scale)
        .when(n < 50_000_000, F.lit(10_000_000))
        .when(n < 100_000_000, F.lit(50_000_000))
        .otherwise(F.lit(100_000_000))
        .cast("long")
    )


def _one_percent_points() -> list[tuple[int, int]]:
    return [
        (start * (i + 1), bits)
        for start, decade in ONE_PERCENT_BITS.items()
        for i, bits in enumerate(decade)
    ] + list(ONE_PERCENT_TAIL)


def one_percent_bits(n_max: int) -> int:
    """Plain-number form of :func:`linear_bits_one_percent`, before byte rounding."""
    points = _one_percent_points()
    if n_max < points[0][0]:
        return points[0][1]
    if n_max > points[-1][0]:
        return n_max // 12
    i = min(bisect.bisect_right(points, (n_max, math.inf)), len(points) - 1)
    (x0, y0), (x1, y1) = points[i - 1], points[i]
    return math.ceil(y0 + (n_max - x0) * (y1 - y0) / (x1 - x0))


def bits_for_error(n_max: int, error: float) -> int:
    """Plain-number form of :func:`linear_bits_for_error`."""
    if not 0 < error < 1 or n_max <= 0:
        raise ValueError("need 0 < error < 1 and a positive maximum")

    def enough(length: int) -> bool:
        t = n_max / length
        if t > 700:  # exp would overflow; far too short anyway
            return False
        return length > max(1 / (error * t) ** 2, 5) * (math.exp(t) - t - 1)

    return bisect.bisect_left(range(1 << LC_SEARCH_STEPS), True, lo=1, key=enough)


def linear_bits_one_percent(groups: DataFrame, n: str, out: str = "lc_bits") -> DataFrame:
    """Linear-counter length for 1 % error, for each row's maximum cardinality."""
    table = F.broadcast(one_percent_breakpoints(groups.sparkSession))
    x = F.col(n).cast("long")
    inside = (x >= 100) & (x <= 120_000_000)
    joined = groups.withColumn("_lo", F.when(inside, one_percent_lower_bound(x))).join(
        table, F.col("_lo") == F.col("lo"), "left"
    )
    bits = (
        F.when(x < 100, F.lit(ONE_PERCENT_BITS[100][0]))
        .when(x > 120_000_000, F.floor(x / 12))
        .otherwise(lerp(x, F.col("lo"), F.col("bits_lo"), F.col("hi"), F.col("bits_hi")))
    )
    whole_bytes = (F.ceil(bits / 8) * 8).cast("long")
    return joined.withColumn(out, whole_bytes).drop("_lo", "lo", "hi", "bits_lo", "bits_hi")


def linear_bits_for_error(n: Column, error: float | Column) -> Column:
    """Smallest length L with L > max(1/(e*t)^2, 5) * (exp(t) - t - 1), t = n/L.

    A bisection inside one expression (a fold over a short sequence), so each
    group solves its own inequality on its own row: no candidate grid, no join.
    """
    eps = F.lit(error) if isinstance(error, float) else error
    x = F.greatest(n, F.lit(1)).cast("double")  # no values need no more than one

    def enough(length: Column) -> Column:
        t = x / length
        need = F.greatest(1.0 / F.pow(eps * t, F.lit(2)), F.lit(5.0)) * (F.exp(t) - t - 1.0)
        return length > need

    def step(bounds: Column, _: Column) -> Column:
        middle = F.floor((bounds["lo"] + bounds["hi"]) / 2).cast("long")
        open_ = bounds["lo"] < bounds["hi"]
        fits = enough(middle.cast("double"))
        return F.struct(
            F.when(open_ & ~fits, middle + 1).otherwise(bounds["lo"]).alias("lo"),
            F.when(open_ & fits, middle).otherwise(bounds["hi"]).alias("hi"),
        )

    start = F.struct(
        F.lit(1).cast("long").alias("lo"), F.lit(1 << LC_SEARCH_STEPS).cast("long").alias("hi")
    )
    steps = F.sequence(F.lit(0), F.lit(LC_SEARCH_STEPS))
    return F.aggregate(steps, start, step, lambda b: b["hi"])


def false_positive_rate(k: Column, bits_per_element: Column) -> Column:
    """(1 - exp(-K / bits-per-element)) ^ K."""
    return F.pow(1 - F.exp(-k / bits_per_element), k)


def bloom_candidates(spark: SparkSession) -> DataFrame:
    """All (bits per element, K, false-positive rate) choices of the sizing search.

    Built from the formula; under 100 rows, fixed.
    """
    choices = [
        (bpe, k)
        for bpe in range(BLOOM_MIN_BITS, BLOOM_MAX_BITS + 1)
        for k in range(1, BEST_K[bpe] + 1)
    ]
    table = literal_table(spark, choices, "bits_per_element", "k")
    return table.withColumn("fpp", false_positive_rate(F.col("k"), F.col("bits_per_element")))


def bloom_spec(target: float) -> tuple[int, int]:
    """(bits per element, K): fewest bits, then fewest hashes, with FPP <= target."""
    for bpe in range(BLOOM_MIN_BITS, BLOOM_MAX_BITS + 1):
        for k in range(1, BEST_K[bpe] + 1):
            if (1 - math.exp(-k / bpe)) ** k <= target:
                return bpe, k
    return BLOOM_MAX_BITS, BLOOM_MAX_K
