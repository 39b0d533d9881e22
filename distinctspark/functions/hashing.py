"""Hash expressions.  Every hash is a non-negative 60-bit BIGINT.

Three interchangeable kinds:

``xx``   Spark's xxhash64, any type, fastest; the default.
``mix``  integer values only: a 5-round Feistel mix of two 30-bit halves, plain
         integer arithmetic, so any SQL engine can repeat it exactly.
``md5``  any type through its text form; the first 15 hex digits of md5.

All are built-in column expressions that stay inside whole-stage codegen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 60
HALF_BITS = 30
HALF_MASK = (1 << HALF_BITS) - 1
#: Mersenne prime the seeded linear family works modulo.
PRIME = (1 << 31) - 1

# Fixed values: (multiplier, addend) of each Feistel round.
MIX_ROUNDS = (
    (970852205, 392926733),
    (897408821, 71572327),
    (610356051, 628236793),
    (111870497, 105974663),
    (168954453, 223405035),
)

HASH_KINDS = ("xx", "mix", "md5")


def hash60(value: str, kind: str = "xx") -> Column:
    """The hash of column ``value``, built from SQL text (one call into the JVM)."""
    return F.expr(hash60_sql(f"`{value}`", kind))


def hash60_sql(value: str, kind: str) -> str:
    if kind == "xx":
        return f"shiftrightunsigned(xxhash64({value}), {64 - HASH_BITS})"
    if kind == "md5":
        return f"CAST(conv(substring(md5(CAST({value} AS STRING)), 1, 15), 16, 10) AS BIGINT)"
    if kind == "mix":
        return _mix_sql(f"CAST({value} AS BIGINT)")
    raise ValueError(f"unknown hash kind {kind!r}; choose from {HASH_KINDS}")


def _mix_sql(v: str) -> str:
    high = f"(shiftright({v}, {HALF_BITS}) & {HALF_MASK}L)"
    low = f"({v} & {HALF_MASK}L)"
    for i, (mul, add) in enumerate(MIX_ROUNDS):
        source = low if i % 2 == 0 else high
        scramble = f"(shiftright(({source} + {add}L) * {mul}L, 15) & {HALF_MASK}L)"
        if i % 2 == 0:
            high = f"({high} ^ {scramble})"
        else:
            low = f"({low} ^ {scramble})"
    return f"(shiftleft({high}, {HALF_BITS}) | {low})"


def high_half(h: Column) -> Column:
    return F.shiftright(h, HALF_BITS)


def low_half(h: Column) -> Column:
    return h.bitwiseAND(HALF_MASK)


def bit_length(x: Column) -> Column:
    """Number of significant bits of 0 <= x < 2^61, exactly, without text conversion.

    y = 2x + 1 is never 0, and y & ~(y >> 1) keeps y's top bit but clears the
    bit below it, so its base-2 logarithm lies in [k, k + 0.59): the quarter
    added before rounding down absorbs any floating-point error.
    """
    y = x * 2 + 1
    top = y.bitwiseAND(F.bitwise_not(F.shiftright(y, 1)))
    return F.floor(F.log2(top) + 0.25).cast("int")


def leading_rank(x: Column, width: int) -> Column:
    """1 + number of leading zeros of ``x`` seen as ``width`` bits; width+1 for 0."""
    return F.lit(width + 1) - bit_length(x)


def trailing_zeros(x: Column, width: int = HASH_BITS) -> Column:
    """Number of trailing zero bits of a non-negative value; ``width`` for 0."""
    # x = 0 gives bit_count(-1) = 64, which the bound turns into ``width``.
    return F.least(F.bit_count(x.bitwiseAND(-x) - 1), F.lit(width))


def lowest_unset_bit(x: Column) -> Column:
    """Index of the lowest 0 bit of a non-negative value."""
    return F.bit_count(F.bitwise_not(x).bitwiseAND(x + 1) - 1)


def family_coefficients(seed: int) -> tuple[int, ...]:
    """Six pseudo-random 28-bit coefficients of seeded hash number ``seed``."""
    digits = "".join(hashlib.md5(f"{lane}:{seed}".encode()).hexdigest()[:21] for lane in "ab")
    return tuple(int(digits[i : i + 7], 16) for i in range(0, 42, 7))


def with_seeds(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` once per seeded hash number, with columns ``seed`` and a..f.

    The coefficients are one literal array, so this is a narrow map-side step.
    """
    structs = ", ".join(
        f"struct({seed} AS seed, "
        + ", ".join(
            f"{v}L AS {name}"
            for name, v in zip("abcdef", family_coefficients(seed), strict=True)
        )
        + ")"
        for seed in range(n)
    )
    return rows.selectExpr("*", f"inline(array({structs}))")


def seeded_hash(h: str = "h") -> Column:
    """A member (columns a..f) of a linear hash family over the halves of ``h``.

    Two lanes ``(a*high + b*low + c) mod PRIME`` give the halves of 60 bits.
    """
    high, low = f"shiftright({h}, {HALF_BITS})", f"({h} & {HALF_MASK}L)"
    lanes = [
        f"(pmod({x} * {high} + {y} * {low} + {z}, {PRIME}L) & {HALF_MASK}L)"
        for x, y, z in ("abc", "def")
    ]
    return F.expr(f"shiftleft({lanes[0]}, {HALF_BITS}) | {lanes[1]}")


def bloom_position(h: Column, i: int | Column, bits: int) -> Column:
    """Double-hash bit position number ``i``: ``(h1 + i*h2) mod bits``."""
    step = F.lit(i) if isinstance(i, int) else i
    return F.pmod(high_half(h) + step.cast("long") * low_half(h), F.lit(bits).cast("long"))


def bloom_positions(h: Column, k: int, bits: int) -> Column:
    """All ``k`` positions as an array."""
    return F.array(*[bloom_position(h, i, bits) for i in range(k)])


def evaluated_once(column: Column) -> Column:
    """``column``, kept out of predicates above it.

    A filter is not pushed below a projection with a non-deterministic part, so
    the always-true test on the partition id keeps an expensive expression from
    being copied into every term of the filter.
    """
    return F.when(F.spark_partition_id() >= 0, column)
