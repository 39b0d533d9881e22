"""The registered queries again, as plain SQL for another engine.

Written independently of the DataFrame code: hashes and sketches are spelled
out as group-bys.  Only fixed constants are shared.
"""

from __future__ import annotations

import math

from distinctspark.functions import sizing
from distinctspark.functions.bias import LINEAR_BELOW, bias_table
from distinctspark.functions.hashing import MIX_ROUNDS
from distinctspark.operators.registers import HLL_ALPHA_SMALL
from distinctspark.workloads.queries import (
    BUFFER_SLIDE_MS,
    BUFFERED,
    DISPATCH,
    ESTIMATES,
    MERGES,
    METHODS,
    SIZE_MS,
    SLIDE_MS,
)

#: Event types of the given tables.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
M30 = (1 << 30) - 1
PRIME = (1 << 31) - 1
EVENTS = (
    "(SELECT *, epoch_us(ts) AS ts_us, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
)

# LogLog bias correction m*alpha_m for m = 2^k, k = 0..31.
LOGLOG_ALPHA_M = (
    0,
    0.44567926005415,
    1.2480639342271,
    2.8391255240079,
    6.0165231584811,
    12.369319965552,
    25.073991603109,
    50.482891762521,
    101.30047482549,
    202.93553337953,
    406.20559693552,
    812.74569741657,
    1625.8258887309,
    3251.9862249084,
    6504.3071471860,
    13008.949929672,
    26018.222470181,
    52036.684135280,
    104073.41696276,
    208139.24771523,
    416265.57100022,
    832478.53851627,
    1669443.2499579,
    3356902.8702907,
    6863377.8429508,
    11978069.823687,
    31333767.455026,
    52114301.457757,
    72080129.928986,
    68945006.880409,
    31538957.552704,
    3299942.4347441,
)


# -- hashes ------------------------------------------------------------------


def mix(v: str) -> str:
    high, low = f"((({v})::BIGINT >> 30) & {M30})", f"(({v})::BIGINT & {M30})"
    for i, (mul, add) in enumerate(MIX_ROUNDS):
        source = low if i % 2 == 0 else high
        scramble = f"(((({source} + {add}) * {mul}) >> 15) & {M30})"
        if i % 2 == 0:
            high = f"xor({high}, {scramble})"
        else:
            low = f"xor({low}, {scramble})"
    return f"(({high} << 30) | {low})"


def md5h(v: str) -> str:
    return f"('0x' || substr(md5(CAST({v} AS VARCHAR)), 1, 15))::BIGINT"


def lead(x: str, width: int) -> str:
    return f"(CASE WHEN {x} = 0 THEN {width + 1} ELSE {width + 1} - length(bin({x})) END)"


def tz(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 60 ELSE length(bin({x})) - length(rtrim(bin({x}), '0')) END)"


def seeds(n: int) -> str:
    """Coefficients of ``n`` seeded hashes."""
    parts = []
    for lane, names in (("a", "abc"), ("b", "def")):
        parts += [
            f"('0x' || substr(md5('{lane}:' || s), {1 + 7 * i}, 7))::BIGINT AS {name}"
            for i, name in enumerate(names)
        ]
    return f"(SELECT s, {', '.join(parts)} FROM range({n}) t(s))"


def seeded(h: str) -> str:
    hi, lo = f"({h} >> 30)", f"({h} & {M30})"
    first = f"((a * {hi} + b * {lo} + c) % {PRIME})"
    second = f"((d * {hi} + e * {lo} + f) % {PRIME})"
    return f"((({first} & {M30}) << 30) | ({second} & {M30}))"


def lowest_unset(x: str) -> str:
    """Length of the run of trailing ones."""
    return f"(length(bin({x})) - length(rtrim(bin({x}), '1')))"


# -- estimates: each takes a source of (keys, h) rows ------------------------


def alpha(p: int) -> float:
    return HLL_ALPHA_SMALL.get(p, 0.7213 / (1 + 1.079 / (1 << p)))


def registers(src: str, k: str, p: int) -> str:
    w = 60 - p
    rank = lead(f"(h & {(1 << w) - 1})", w)
    by = f"{k}, " if k else ""
    grp = f"GROUP BY {k}" if k else ""
    return (
        f"(SELECT {by}sum(r) AS s, sum(pow(2.0, -r)) AS z, count(*) AS t FROM "
        f"(SELECT {by}h >> {w} AS b, max({rank}) AS r FROM {src} GROUP BY {by}b) {grp})"
    )


def ll_formula(p: int) -> str:
    return f"floor({LOGLOG_ALPHA_M[p]!r} * pow(2.0, s / {float(1 << p)}))"


def hll_formula(p: int) -> str:
    m = 1 << p
    raw = f"({alpha(p) * m * m!r} / (z + ({m} - t)))"
    return (
        f"CASE WHEN {raw} <= {2.5 * m} AND t < {m} THEN "
        f"round({float(m)} * ln({float(m)} / ({m} - t))) ELSE round({raw}) END"
    )


def ac_formula(p: int) -> str:
    m = 1 << p
    empty = f"(({m} - t) / {float(m)})"
    return (
        f"CASE WHEN {empty} >= 0.051 THEN round(-{float(m)} * ln({empty})) ELSE {ll_formula(p)} END"
    )


def est_registers(src: str, k: str, p: int, formula: str) -> str:
    return f"(SELECT {k}, CAST({formula} AS BIGINT) AS estimate FROM {registers(src, k, p)})"


def bias_formula(p: int) -> str:
    """Of raw estimate e and linear counting l (NULL without empty registers)."""
    raws, biases = bias_table(p, alpha(p))
    m, below = 1 << p, LINEAR_BELOW[p - 4]
    places = f"list_transform(range({len(raws)}), lambda i: {{'d': abs({list(raws)}[i + 1] - e), 'b': {list(biases)}[i + 1]}})"
    nearest = f"list_sum(list_transform(list_sort({places})[1:6], lambda x: x.b)) / 6"
    corrected = f"(CASE WHEN e <= {5.0 * m} THEN e - {nearest} ELSE e END)"
    return f"round(CASE WHEN l < {below} THEN l ELSE {corrected} END)"


def est_hllp(src: str, k: str, p: int, sp: int, bias: bool = False) -> str:
    sparse = (
        f"(SELECT {k}, count(DISTINCT h >> {60 - sp}) AS n FROM {src} GROUP BY {k})"
    )
    # A dense rank seen through the sparse index equals the rank of the whole rest.
    m = 1 << p
    dense = (
        f"(SELECT *, {alpha(p) * m * m!r} / (z + ({m} - t)) AS e, CASE WHEN t < {m} THEN "
        f"{float(m)} * ln({float(m)} / ({m} - t)) END AS l FROM {registers(src, k, p)})"
    )
    sm = float(1 << sp)
    formula = bias_formula(p) if bias else hll_formula(p)
    return (
        f"(SELECT {k}, CAST(CASE WHEN n <= {int(0.75 * (1 << p))} THEN "
        f"round({sm} * ln({sm} / ({sm} - n))) ELSE {formula} END AS BIGINT) AS estimate "
        f"FROM {sparse} JOIN {dense} USING ({k}))"
    )


def est_lc(src: str, k: str, bits: int) -> str:
    L = float(bits)
    return (
        f"(SELECT {k}, CASE WHEN n < {bits} THEN "
        f"CAST(round({L} * ln({L} / ({bits} - n))) AS BIGINT) END AS estimate FROM "
        f"(SELECT {k}, count(DISTINCT h % {bits}) AS n FROM {src} GROUP BY {k}))"
    )


def est_fm(src: str, k: str, groups: int, hashes: int) -> str:
    bits = (
        f"(SELECT {k}, s, bit_or(1::BIGINT << {tz(seeded('h'))}) AS m FROM "
        f"(SELECT DISTINCT {k}, h FROM {src}), {seeds(groups * hashes)} GROUP BY {k}, s)"
    )
    means = (
        f"(SELECT {k}, s // {hashes} AS g, sum({lowest_unset('m')}) / {hashes} AS r "
        f"FROM {bits} GROUP BY {k}, g)"
    )
    return (
        f"(SELECT {k}, CAST(floor(pow(2.0, median(r)) / 0.77351) AS BIGINT) AS estimate "
        f"FROM {means} GROUP BY {k})"
    )


def kmv_formula(k: int) -> str:
    return (
        f"CAST(CASE WHEN n < {k} THEN n ELSE "
        f"floor({(k - 1) * float(1 << 60)!r}::DOUBLE / kth::DOUBLE) END AS BIGINT)"
    )


def est_kmv(src: str, keys: str, k: int) -> str:
    ranked = (
        f"(SELECT {keys}, h, row_number() OVER (PARTITION BY {keys} ORDER BY h) AS rn "
        f"FROM (SELECT DISTINCT {keys}, h FROM {src}))"
    )
    return (
        f"(SELECT {keys}, {kmv_formula(k)} AS estimate FROM (SELECT {keys}, count(*) AS n, "
        f"max(h) AS kth FROM {ranked} WHERE rn <= {k} GROUP BY {keys}))"
    )


def positions(h: str, k: int, bits: int) -> str:
    return f"unnest([(({h} >> 30) + i * ({h} & {M30})) % {bits} FOR i IN range({k})])"


def est_bf(src: str, keys: str, bits: int, k: int, formula: str = "swamidass") -> str:
    b = float(bits)
    unset = f"ln(1 - x / {b})"
    if formula == "swamidass":
        value = f"-({b} / {k}) * {unset}"
    else:
        value = f"{unset} / ({float(k)} * ln({1 - 1 / b!r}))"
    return (
        f"(SELECT {keys}, CASE WHEN x < {bits} THEN CAST(floor({value}) AS BIGINT) END "
        f"AS estimate FROM (SELECT {keys}, count(DISTINCT bit) AS x FROM "
        f"(SELECT {keys}, {positions('h', k, bits)} AS bit FROM {src}) GROUP BY {keys}))"
    )


def block_places(blocks: int, k: int) -> str:
    """block, bit of every bit of hash ``h``."""
    low = f"(h & {M30})"
    return (
        f"(h >> 30) % {blocks} AS block, "
        f"unnest([({low} + i * (({low} >> 15) | 1)) & 32767 FOR i IN range({k})]) AS bit"
    )


def est_bfb(src: str, keys: str, blocks: int, k: int) -> str:
    return (
        f"(SELECT {keys}, CASE WHEN max(x) < 32768 THEN "
        f"CAST(round(sum(-(32768.0::DOUBLE / {k}) * ln(1 - x / 32768.0::DOUBLE))) AS BIGINT) END AS estimate "
        f"FROM (SELECT {keys}, block, least(count(DISTINCT bit), 32767.5) AS x FROM "
        f"(SELECT {keys}, {block_places(blocks, k)} FROM {src}) GROUP BY {keys}, block) GROUP BY {keys})"
    )


def est_bjkst(
    src: str, k: str, tries: int, set_size: int, error: float, combine_by: str = "median"
) -> str:
    buffer = int(set_size / error**2) - (1 if tries == 1 else 0)
    counts = (
        f"(SELECT {k}, s, {tz(seeded('h'))} AS z, count(*) AS n FROM "
        f"(SELECT DISTINCT {k}, h FROM {src}), {seeds(tries)} GROUP BY {k}, s, z)"
    )
    suffix = (
        f"(SELECT *, sum(n) OVER (PARTITION BY {k}, s ORDER BY z DESC) AS cum FROM {counts})"
    )
    levels = (
        f"(SELECT {k}, s, coalesce(max(z) FILTER (cum > {buffer}), -1) + 1 AS lv "
        f"FROM {suffix} GROUP BY {k}, s)"
    )
    guesses = (
        f"(SELECT {k}, s, sum(CASE WHEN z >= lv THEN n ELSE 0 END) * pow(2, any_value(lv)) "
        f"AS guess FROM {counts} JOIN {levels} USING ({k}, s) GROUP BY {k}, s)"
    )
    if combine_by == "median":
        return (
            f"(SELECT {k}, CAST(floor(median(guess)) AS BIGINT) AS estimate "
            f"FROM {guesses} GROUP BY {k})"
        )
    votes = f"(SELECT {k}, guess, count(*) AS votes FROM {guesses} GROUP BY {k}, guess)"
    return (
        f"(SELECT {k}, CAST(guess AS BIGINT) AS estimate FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {k} ORDER BY votes DESC, guess) AS rn FROM {votes}) WHERE rn = 1)"
    )


def est_cte(src: str, k: str, tip: int, p: int) -> str:
    exact = f"(SELECT {k}, count(DISTINCT h) AS n FROM {src} GROUP BY {k})"
    return (
        f"(SELECT {k}, CAST(CASE WHEN n <= {tip} THEN n ELSE {ac_formula(p)} END AS BIGINT) "
        f"AS estimate FROM {exact} JOIN {registers(src, k, p)} USING ({k}))"
    )


def est_exact(src: str, k: str) -> str:
    return f"(SELECT {k}, count(DISTINCT h) AS estimate FROM {src} GROUP BY {k})"


def estimate(alg: str, src: str, k: str, params: dict) -> str:
    params = {n: v for n, v in params.items() if n != "hash"}
    error = params.get("error") if alg != "BJKST" or len(params) == 1 else None
    if error is not None:
        half = lambda n: 1 << (math.ceil(math.log2(n)) - 1)
        params = {
            "LL": lambda e: {"p": int(math.log2(half(int((1.30 / e) ** 2))))},
            "HLL": lambda e: {"p": int(math.log2(half(int((1.04 / e) ** 2))))},
            "FM": lambda e: {"groups": 1, "hashes": half(int((1 / e) ** 2))},
            "KMV": lambda e: {"k": half(int(2 + 2 / (math.pi * e * e)))},
            "BJKST": lambda e: {"tries": 1, "set_size": 576, "error": e},
        }[alg](error)
    p = params.get("p", 0)
    if alg == "LL":
        return est_registers(src, k, p, ll_formula(p))
    if alg == "HLL":
        return est_registers(src, k, p, hll_formula(p))
    if alg == "AC":
        return est_registers(src, k, p, ac_formula(p))
    builders = {
        "HLLP": est_hllp, "LC": est_lc, "LCP": est_lc, "BFB": est_bfb, "FM": est_fm, "BF": est_bf,
        "BJKST": est_bjkst, "CTE": est_cte, "EXACT": est_exact,
    }
    if alg == "KMV":
        return est_kmv(src, k, params["k"])
    return builders[alg](src, k, **params)


def source(table: str, k: str, value: str, hash: str = "mix") -> str:
    fn = mix if hash == "mix" else md5h
    name = EVENTS if table == "events" else table
    return f"(SELECT {k}, {fn(value)} AS h FROM {name} WHERE {value} IS NOT NULL)"


ORACLES: dict[str, str] = {}

# -- exact -------------------------------------------------------------------

ORACLES["exact_distinct"] = (
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY 1"
)
ORACLES["exact_distinct_users"] = (
    "SELECT event_type, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY 1"
)
ORACLES["exact_distinct_texts"] = (
    "SELECT lang, count(DISTINCT text) AS n_distinct FROM documents GROUP BY 1"
)
ORACLES["item_count"] = (
    "SELECT l_returnflag, l_linestatus, count(*) AS n_items FROM lineitem GROUP BY 1, 2"
)
ORACLES["bitmap_native"] = (
    "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem GROUP BY 1"
)

# -- estimates ---------------------------------------------------------------

for _name, (_table, _keys, _value, _alg, _params) in ESTIMATES.items():
    _k = ", ".join(_keys)
    _src = source(_table, _k, _value, _params.get("hash", "mix"))
    ORACLES[_name] = f"SELECT * FROM {estimate(_alg, _src, _k, _params)}"

for _name, (_alg, _value, _params) in MERGES.items():
    _src = source("lineitem", "l_returnflag", _value)
    ORACLES[_name] = f"SELECT * FROM {estimate(_alg, _src, 'l_returnflag', _params)}"

_mixed = (
    f"(SELECT l_linenumber, l_returnflag, count(DISTINCT {mix('l_orderkey')} >> 42) > 1536 AS d "
    "FROM lineitem GROUP BY 1, 2)"
)
_merged = source("lineitem", "l_linenumber", "l_orderkey")
ORACLES["merge_hllpp_mixed"] = (
    "SELECT l_linenumber, estimate, n_sparse, n_dense, is_dense, true AS is_bounded FROM "
    f"{estimate('HLLP', _merged, 'l_linenumber', {'p': 11, 'sp': 18})} JOIN (SELECT l_linenumber, "
    f"count(*) FILTER (NOT d) AS n_sparse, count(*) FILTER (d) AS n_dense FROM {_mixed} GROUP BY 1) "
    "USING (l_linenumber) JOIN (SELECT l_linenumber, count(DISTINCT h >> 42) > 1536 AS is_dense "
    f"FROM {_merged} GROUP BY 1) USING (l_linenumber)"
)

_lc_n = (
    "(SELECT o_orderpriority, count(o_custkey) AS n_max FROM orders GROUP BY o_orderpriority)"
)


def _sized_lc(lengths: str) -> str:
    return (
        f"WITH len AS ({lengths}), bits AS (SELECT o_orderpriority, lc_bits, "
        f"count(DISTINCT {mix('o_custkey')} % lc_bits) AS n FROM orders JOIN len "
        "USING (o_orderpriority) GROUP BY 1, 2) "
        "SELECT o_orderpriority, lc_bits, CASE WHEN n < lc_bits THEN "
        "CAST(round(lc_bits::DOUBLE * ln(lc_bits::DOUBLE / (lc_bits - n))) AS BIGINT) END "
        "AS estimate FROM bits"
    )


_points = [
    (start * (i + 1), bits)
    for start, decade in sizing.ONE_PERCENT_BITS.items()
    for i, bits in enumerate(decade)
] + list(sizing.ONE_PERCENT_TAIL)
_ranges = ", ".join(
    f"({lo}, {hi}, {y0}, {y1})"
    for (lo, y0), (hi, y1) in zip(_points[:-1], _points[1:], strict=True)
)
ORACLES["linear_counting_1pct"] = _sized_lc(
    f"SELECT o_orderpriority, CAST(ceil((CASE WHEN n_max < 100 THEN 5034 "
    f"WHEN n_max > 120000000 THEN n_max // 12 "
    f"ELSE ceil(y0 + (n_max - lo) * (y1 - y0)::DOUBLE / (hi - lo)) END) / 8.0) * 8 AS BIGINT) "
    f"AS lc_bits FROM {_lc_n} LEFT JOIN (VALUES {_ranges}) t(lo, hi, y0, y1) "
    "ON n_max >= lo AND n_max < hi"
)
ORACLES["linear_counting_eps"] = _sized_lc(
    "SELECT o_orderpriority, CAST(ceil(min(m) / 8.0) * 8 AS BIGINT) AS lc_bits FROM "
    f"(SELECT *, n_max::DOUBLE / m AS t FROM {_lc_n}, range(1, 200000) g(m)) "
    "WHERE t < 500 AND m > greatest(1.0 / pow(0.05 * t, 2), 5.0) * (exp(t) - t - 1.0) GROUP BY 1"
)
ORACLES["lc_utilisation"] = (
    "SELECT o_orderstatus, o_orderpriority, n AS n_set, "
    "CASE WHEN n < 256 THEN CAST(round(256.0 * ln(256.0::DOUBLE / (256 - n))) AS BIGINT) END "
    "AS estimate, round(n / 256.0::DOUBLE, 6) AS utilisation, n = 256 AS saturated FROM "
    f"(SELECT o_orderstatus, o_orderpriority, count(DISTINCT {mix('o_custkey')} % 256) AS n "
    "FROM orders GROUP BY 1, 2)"
)

# -- Bloom -------------------------------------------------------------------

_choices = ", ".join(
    f"({bpe}, {k})"
    for bpe in range(2, 16)
    for k in range(1, sizing.BEST_K[bpe] + 1)
)
_fpp = "pow(1 - exp(-k::DOUBLE / bits_per_element), k)"
ORACLES["bloom_sizing"] = (
    f"WITH choice AS (SELECT *, {_fpp} AS fpp FROM (VALUES {_choices}) t(bits_per_element, k)), "
    "grp AS (SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_distinct, "
    "round(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) / 100.0::DOUBLE, 2) AS target "
    "FROM orders GROUP BY o_orderpriority), ok AS (SELECT *, row_number() OVER (PARTITION BY "
    "o_orderpriority ORDER BY bits_per_element, k) AS rn FROM grp JOIN choice ON fpp <= target) "
    "SELECT o_orderpriority, n_distinct, target, bits_per_element, k, "
    "n_distinct * bits_per_element AS bits, round(fpp, 9) AS fpp FROM ok WHERE rn = 1"
)


def _semi(bits: int, k: int) -> str:
    h = mix("c_custkey")
    p = mix("o_custkey")
    return (
        f"WITH bits AS (SELECT DISTINCT {positions('h', k, bits)} AS bit FROM "
        f"(SELECT {h} AS h FROM customer WHERE c_mktsegment = 'BUILDING')), probe AS "
        f"(SELECT o_orderkey, o_custkey, {positions('h', k, bits)} AS bit FROM "
        f"(SELECT o_orderkey, o_custkey, {p} AS h FROM orders)) "
        "SELECT o_orderkey, o_custkey FROM probe GROUP BY o_orderkey, o_custkey "
        "HAVING bool_and(bit IN (SELECT bit FROM bits))"
    )


ORACLES["bloom_semi_filter"] = _semi(1 << 14, 3)
_member = f"(SELECT {mix('c_custkey')} AS h FROM customer WHERE c_mktsegment = 'BUILDING')"
_probe = f"(SELECT o_orderkey, o_custkey, {mix('o_custkey')} AS h FROM orders)"
ORACLES["bloom_blocked_semi"] = (
    f"WITH s AS (SELECT DISTINCT * FROM (SELECT {block_places(1 << 16, 6)} FROM {_member})), "
    f"p AS (SELECT DISTINCT h, {block_places(1 << 16, 6)} FROM {_probe}), "
    "hit AS (SELECT h FROM p LEFT JOIN s ON s.block = p.block AND s.bit = p.bit GROUP BY h "
    "HAVING count(*) = count(s.bit)) "
    f"SELECT o_orderkey, o_custkey FROM {_probe} WHERE h IN (SELECT h FROM hit)"
)
ORACLES["bloom_semi_filter_wide"] = _semi(1 << 24, 4)

# -- KMV overlap -------------------------------------------------------------


def _overlap(rows: str, keys: str, k: int) -> str:
    return (
        f"WITH sk AS (SELECT {keys}, member, h FROM (SELECT *, row_number() OVER (PARTITION BY "
        f"{keys}, member ORDER BY h) AS rn FROM (SELECT DISTINCT {keys}, member, h FROM {rows})) "
        f"WHERE rn <= {k}), mem AS (SELECT {keys}, count(DISTINCT member) AS n_members FROM sk "
        f"GROUP BY {keys}), un AS (SELECT {keys}, h, count(*) AS held, row_number() OVER "
        f"(PARTITION BY {keys} ORDER BY h) AS rn FROM sk GROUP BY {keys}, h), tot AS "
        f"(SELECT {keys}, count(*) AS n, max(h) AS kth, count(*) FILTER (held = n_members) AS sh "
        f"FROM un JOIN mem USING ({keys}) WHERE rn <= {k} "
        f"GROUP BY {keys}) SELECT {keys}, {kmv_formula(k)} AS union_estimate, "
        f"round(sh / n, 6) AS jaccard, CAST(round(sh / n * {kmv_formula(k)}) AS BIGINT) "
        "AS intersection_estimate FROM tot"
    )


ORACLES["kmv_set_overlap"] = _overlap(
    f"(SELECT l_returnflag, l_linestatus AS member, {mix('l_orderkey')} AS h FROM lineitem)",
    "l_returnflag",
    1024,
)
for _name, _column in (
    ("kmv_union", "union_estimate"),
    ("kmv_jaccard", "jaccard"),
    ("kmv_intersection", "intersection_estimate"),
):
    ORACLES[_name] = f"SELECT l_returnflag, {_column} FROM ({ORACLES['kmv_set_overlap']})"
ORACLES["kmv_overlap_appended"] = ORACLES["kmv_set_overlap"]
ORACLES["kmv_pair_overlap"] = _overlap(
    "(SELECT p.l_returnflag AS \"left\", 'N' AS \"right\", l.l_returnflag AS member, "
    f"{mix('l_orderkey')} AS h FROM (SELECT DISTINCT l_returnflag FROM lineitem "
    "WHERE l_returnflag <> 'N') p JOIN lineitem l ON l.l_returnflag IN (p.l_returnflag, 'N'))",
    '"left", "right"',
    512,
)

# -- windows -----------------------------------------------------------------


def windows(rows: str, size_us: int, slide_us: int) -> str:
    """Expand (ts_us, ...) rows into every window that holds them."""
    n = -(-size_us // slide_us)
    start = f"(ts_us // {slide_us} - i) * {slide_us}"
    return (
        f"(SELECT * FROM (SELECT r.*, {start} AS window_start, {start} + {size_us} AS window_end "
        f"FROM {rows} r, range({n}) g(i)) WHERE ts_us < window_end)"
    )


def windowed(rows: str, key: str, size_ms: int, slide_ms: int, alg: str, p: int) -> str:
    expanded = windows(rows, size_ms * 1000, slide_ms * 1000)
    k = f"window_start, window_end, {key}"
    return estimate(alg, expanded, k, {"p": p} if p else {})


_ev = f"(SELECT event_type, ts_us, {mix('user_id')} AS h FROM {EVENTS})"
_slide = windowed(_ev, "event_type", SIZE_MS, SLIDE_MS, "HLL", 6)
ORACLES["sliding_direct"] = ORACLES["sliding_sliced"] = f"SELECT * FROM {_slide}"
ORACLES["sliding_exact"] = ORACLES["sliding_exact_intervals"] = (
    f"SELECT * FROM {windowed(_ev, 'event_type', SIZE_MS, SLIDE_MS, 'EXACT', 0)}"
)
ORACLES["sliding_cte"] = "SELECT * FROM " + estimate(
    "CTE", windows(_ev, SIZE_MS * 1000, SLIDE_MS * 1000),
    "window_start, window_end, event_type", {"tip": 40, "p": 8},
)
ORACLES["sliding_hllpp"] = "SELECT * FROM " + estimate(
    "HLLP", windows(_ev, SIZE_MS * 1000, SLIDE_MS * 1000),
    "window_start, window_end, event_type", {"p": 6, "sp": 14},
)
ORACLES["sliding_uneven"] = (
    f"SELECT * FROM {windowed(_ev, 'event_type', 36_000_000, 14_400_000, 'HLL', 6)}"
)
ORACLES["tumbling"] = f"SELECT * FROM {windowed(_ev, 'event_type', SIZE_MS, SIZE_MS, 'HLL', 6)}"


def _with_metadata(rows: str, key: str, ts: str, estimate_sql: str) -> str:
    expanded = windows(rows, SIZE_MS * 1000, SLIDE_MS * 1000)
    k = f"window_start, window_end, {key}"
    return (
        f"(SELECT {k}, n_items, first_ts, last_ts, estimate FROM (SELECT {k}, count(*) AS n_items, "
        f"min({ts}) AS first_ts, max({ts}) AS last_ts FROM {expanded} GROUP BY {k}) "
        f"JOIN {estimate_sql} USING ({k}))"
    )


ORACLES["window_metadata"] = (
    f"SELECT * FROM {_with_metadata(_ev, 'event_type', 'ts_us', _slide)}"
)
_fine = f"(SELECT event_type, ts_us // 3600000 AS ts_us, {mix('user_id')} AS h FROM {EVENTS})"
ORACLES["sliding_fine"] = f"SELECT * FROM {windowed(_fine, 'event_type', 2, 1, 'HLL', 4)}"
_by_ts = (
    f"(SELECT ts_us // 3600 // 1000 AS ts_ms, ts_us // 3600 AS ts_us, {mix('user_id')} AS h "
    f"FROM {EVENTS})"
)
ORACLES["sliding_by_timestamp"] = f"SELECT * FROM {windowed(_by_ts, 'ts_ms', 1000, 500, 'HLL', 4)}"

# -- novelty -----------------------------------------------------------------

_nov = f"(SELECT event_id, event_type, ts_us, {mix('cents')} AS h FROM {EVENTS})"
_w8 = 52
ORACLES["novelty_flag"] = (
    "SELECT event_id, event_type, r > coalesce(max(r) OVER (PARTITION BY event_type, b ORDER BY "
    "ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS is_novel FROM "
    f"(SELECT *, h >> {_w8} AS b, {lead(f'(h & {(1 << _w8) - 1})', _w8)} AS r FROM {_nov})"
)
_first = (
    "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, {slot} "
    "ORDER BY ts_us, event_id) = 1 AS is_novel FROM {rows}"
)
ORACLES["novelty_exact"] = _first.format(slot="h", rows=_nov)
ORACLES["novelty_lc"] = _first.format(slot="h % 4096", rows=_nov)

_firsts = (
    "(SELECT event_type, h, min({ts_us: ts_us, event_id: event_id}) AS at FROM "
    f"{_nov} GROUP BY event_type, h)"
)
ORACLES["novelty_kmv"] = (
    f"WITH f AS {_firsts}, novel AS (SELECT x.at.event_id AS event_id FROM f x LEFT JOIN f y "
    "ON x.event_type = y.event_type AND y.h < x.h AND y.at < x.at "
    "GROUP BY x.event_type, x.h, x.at HAVING count(y.h) < 64) "
    "SELECT event_id, event_type, event_id IN (SELECT event_id FROM novel) AS is_novel FROM events"
)
ORACLES["novelty_fm"] = (
    "SELECT event_id, event_type, bool_or(rn = 1) AS is_novel FROM (SELECT event_id, event_type, "
    "row_number() OVER (PARTITION BY event_type, s, z ORDER BY ts_us, event_id) AS rn FROM "
    f"(SELECT *, {tz(seeded('h'))} AS z FROM {_nov}, {seeds(9)})) GROUP BY event_id, event_type"
)

ORACLES["novelty_bloom"] = (
    "SELECT event_id, event_type, bool_or(rn = 1) AS is_novel FROM (SELECT event_id, event_type, "
    "row_number() OVER (PARTITION BY event_type, bit ORDER BY ts_us, event_id) AS rn FROM "
    f"(SELECT *, {positions('h', 4, 1 << 13)} AS bit FROM {_nov})) GROUP BY event_id, event_type"
)

_before = "ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _seen(fine: str) -> str:
    """Events with the number of distinct ``fine`` slots of their key before them, and if theirs is new."""
    return (
        f"(SELECT *, coalesce(sum(fresh::INT) OVER (PARTITION BY event_type {_before}), 0) AS seen FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY event_type, {fine} ORDER BY ts_us, event_id) = 1 "
        f"AS fresh FROM {_nov}))"
    )


def _raises(p: int) -> str:
    """If a row raises its register."""
    w = 60 - p
    rank = lead(f"(h & {(1 << w) - 1})", w)
    return (
        f"{rank} > coalesce(max({rank}) OVER (PARTITION BY event_type, h >> {w} {_before}), 0)"
    )


ORACLES["novelty_hllpp"] = (
    f"SELECT event_id, event_type, CASE WHEN seen <= 192 THEN {_raises(14)} ELSE {_raises(8)} END "
    f"AS is_novel FROM {_seen('h >> 46')}"
)
ORACLES["novelty_cte"] = (
    f"SELECT event_id, event_type, CASE WHEN seen <= 150 THEN fresh ELSE {_raises(8)} END "
    f"AS is_novel FROM {_seen('h')}"
)
ORACLES["novelty_cte_lc"] = (
    "SELECT event_id, event_type, CASE WHEN seen <= 150 THEN fresh ELSE row_number() OVER "
    f"(PARTITION BY event_type, h >> 51 ORDER BY ts_us, event_id) = 1 END AS is_novel FROM {_seen('h')}"
)
# A hash of level z enters a try while no more than the buffer of at least z have come before it.
_room = int(10 / 0.4**2)
ORACLES["novelty_bjkst"] = (
    f'WITH f AS MATERIALIZED (SELECT event_type, "at" AS first, s, {tz(seeded('h'))} AS z FROM {_firsts}, {seeds(3)}), '
    "lv AS (SELECT first, z, l, row_number() OVER (PARTITION BY event_type, s, l ORDER BY first) AS rn "
    "FROM f, range(61) g(l) WHERE l <= z), "
    f"novel AS (SELECT first.event_id AS event_id FROM lv WHERE l = z AND rn <= {_room} + 1) "
    "SELECT event_id, event_type, event_id IN (SELECT event_id FROM novel) AS is_novel FROM events"
)

# -- event sources -----------------------------------------------------------

ORACLES["csv_roundtrip"] = (
    "SELECT event_type AS key, count(*) AS n, count(DISTINCT cents) AS n_distinct, "
    "CAST(sum(cents) AS BIGINT) AS total, min(ts_us // 1000) AS first_ms, "
    f"max(ts_us // 1000) AS last_ms FROM {EVENTS} GROUP BY 1"
)
ORACLES["duration_cut"] = (
    f"SELECT event_type, count(*) AS n, max(ts_us) AS last_us FROM {EVENTS} "
    "WHERE ts <= (SELECT min(ts) FROM events) + INTERVAL 10 DAY GROUP BY 1"
)
ORACLES["event_rejects"] = (
    "SELECT count(*) AS n_rows, count(*) FILTER (event_id % 7 = 0) AS n_dropped, "
    "count(*) FILTER (event_id % 5 = 0) AS n_no_key, "
    "count(*) FILTER (event_id % 13 = 0 AND event_id % 11 <> 0) AS n_no_value, "
    "count(*) FILTER (event_id % 11 = 0) AS n_bad_value FROM events"
)
ORACLES["fill_missing"] = (
    "SELECT CASE WHEN value < 1 THEN 'DUMMY' ELSE event_type END AS key, count(*) AS n, "
    "count(*) AS n_values FROM events GROUP BY 1"
)
ORACLES["synthetic_events"] = (
    "SELECT 'h1' AS key, 5 * count(*) AS n, 5 * count(DISTINCT event_id) AS n_distinct FROM events"
)

# -- dispatch ----------------------------------------------------------------

_parts = source("lineitem", "l_returnflag", "l_partkey")
ORACLES["alg_dispatch"] = " UNION ALL ".join(
    f"SELECT '{alg}' AS alg, l_returnflag, estimate FROM "
    f"{estimate(alg, _parts, 'l_returnflag', params)}"
    for alg, params in DISPATCH.items()
)
_some = source("(SELECT * FROM lineitem WHERE l_returnflag <> 'R')", "l_returnflag", "l_partkey")
ORACLES["null_only_keys"] = " UNION ALL ".join(
    f"SELECT '{alg}' AS alg, l_returnflag, estimate FROM "
    f"{estimate(alg, _some, 'l_returnflag', params)} UNION ALL SELECT '{alg}', 'R', 0"
    for alg, params in DISPATCH.items()
)
_own = md5h("l_orderkey || '-' || l_linenumber")
ORACLES["prehashed_sketch"] = "SELECT * FROM " + estimate(
    "HLL", f"(SELECT l_returnflag, {_own} AS h FROM lineitem)", "l_returnflag", {"p": 11}
)
ORACLES["hash_family"] = (
    "SELECT l_returnflag, min(mixed) AS min_mix, max(txt) AS max_md5, min(sd) AS min_seeded, "
    f"CAST(sum({lead('mixed', 60)}) AS BIGINT) AS leading, "
    f"CAST(sum({tz('sd')}) AS BIGINT) AS trailing, "
    f"CAST(sum({lowest_unset('mixed')}) AS BIGINT) AS unset, "
    f"CAST(sum(((mixed >> 30) + 3 * (mixed & {M30})) % 1009) AS BIGINT) AS positions FROM "
    f"(SELECT *, {seeded('mixed')} AS sd FROM (SELECT l_returnflag, {mix('l_orderkey')} AS mixed, "
    f"{md5h('l_orderkey')} AS txt FROM lineitem), (SELECT * FROM {seeds(4)} WHERE s = 3)) "
    "GROUP BY l_returnflag"
)


def _half(n: str) -> str:
    return f"CAST(CASE WHEN {n} > 1 THEN pow(2, ceil(log2({n})) - 1) ELSE 0 END AS BIGINT)"


_e = "l_discount"
ORACLES["size_rules"] = (
    f"SELECT {_e}, {_half(f'floor(pow(1.30 / {_e}, 2))')} AS loglog_m, "
    f"{_half(f'floor(pow(1.04 / {_e}, 2))')} AS hll_m, "
    f"{_half(f'floor(pow(1.0 / {_e}, 2))')} AS fm_hashes, "
    f"{_half(f'floor(2 + 2 / (pi() * {_e} * {_e}))')} AS kmv_k, "
    f"CAST(floor(576 / ({_e} * {_e})) AS BIGINT) AS bjkst_buffer, "
    f"CAST(floor(log2(pow(1.106 / {_e}, 2))) AS BIGINT) AS hll_log2m "
    "FROM (SELECT DISTINCT l_discount FROM lineitem WHERE l_discount > 0)"
)

# -- measurements ------------------------------------------------------------

_RUN = (
    "CASE WHEN user_id % 2 = 0 THEN 'aggregate' ELSE 'slicing' END AS approach, "
    "upper(event_type) AS algorithm, CAST(100000 * (1 + user_id % 3) AS VARCHAR) AS tps, "
    "'normal' AS dist, '1' AS run"
)
_kind = "event_id % 3"
_FIELD = {
    "insertion_start": (0, "ts_us"),
    "insertion_end": (0, "ts_us + cents"),
    "query_start": (1, "ts_us"),
    "query_end": (1, "ts_us + cents"),
    "window_end_time": (1, "ts_us"),
    "window_end": (2, "ts_us"),
    "window_count": (2, "user_id % 50 + 1"),
    "out_time": (2, "ts_us + cents"),
}
_fields = ", ".join(
    f"CASE WHEN {_kind} = {kind} THEN {value} END AS {name}"
    for name, (kind, value) in _FIELD.items()
)
_records = (
    f"(SELECT {_RUN}, CASE WHEN {_kind} = 0 THEN '' ELSE 'w' END || ts_us || '|' || event_type "
    f"|| '|' || event_id AS metric_key, {_fields}, CASE {_kind} WHEN 0 THEN 'insertionTime' "
    f"WHEN 1 THEN 'queryTime' ELSE 'throughput' END AS metric, ts_us AS event_time, "
    f"event_type AS key FROM {EVENTS})"
)
ORACLES["metric_assembly"] = f"SELECT * FROM {_records}"


def _summary(start: str, end: str) -> str:
    return (
        "SELECT approach, algorithm, tps, dist, run, count(*) AS n, "
        f"round(avg({end} - {start}), 6) AS mean, round(median({end} - {start}), 6) AS median "
        f"FROM {_records} WHERE {start} IS NOT NULL GROUP BY ALL"
    )


ORACLES["latency_summary"] = _summary("query_start", "query_end")
ORACLES["insertion_summary"] = _summary("insertion_start", "insertion_end")
_run_keys = "approach, algorithm, tps, dist, run"
ORACLES["throughput_cdf"] = (
    f"WITH t AS (SELECT {_run_keys}, out_time, CAST(sum(window_count) AS BIGINT) AS window_count "
    f"FROM {_records} WHERE metric = 'throughput' GROUP BY ALL) SELECT *, "
    f"round(sum(window_count) OVER (PARTITION BY {_run_keys} ORDER BY out_time) / "
    f"sum(window_count) OVER (PARTITION BY {_run_keys}), 9) AS cdf FROM t"
)
ORACLES["append_measurements"] = (
    "SELECT approach, algorithm, count(query_start) AS n_query, "
    "count(window_count) AS n_throughput, CAST(sum(window_count) AS BIGINT) AS items "
    f"FROM {_records} WHERE metric <> 'insertionTime' GROUP BY 1, 2"
)

# -- accuracy ----------------------------------------------------------------

_cents = source("events", "event_type", "cents")
_long = " UNION ALL ".join(
    f"SELECT '{name}' AS name, event_type, estimate FROM "
    f"{estimate(alg, _cents, 'event_type', params)}"
    for name, (alg, params) in METHODS.items()
)
_report = (
    "(SELECT event_type, name, estimate, exact, "
    "abs(estimate::DOUBLE / exact::DOUBLE - 1) AS rel_error FROM "
    f"({_long}) JOIN (SELECT event_type, count(DISTINCT cents) AS exact FROM {EVENTS} GROUP BY 1) "
    "USING (event_type))"
)
_rounded = f"(SELECT * REPLACE (round(rel_error, 6) AS rel_error) FROM {_report})"
ORACLES["accuracy_report"] = f"SELECT * FROM {_rounded}"
ORACLES["accuracy_rank"] = (
    "SELECT * REPLACE (round(rel_error, 6) AS rel_error), rank() OVER (PARTITION BY event_type "
    "ORDER BY estimate DESC) AS rank_by_estimate, rank() OVER (PARTITION BY event_type ORDER BY "
    f"round(rel_error, 9)) AS rank_by_error FROM {_report}"
)
ORACLES["accuracy_pivot"] = (
    "SELECT name, "
    + ", ".join(
        f"max(rel_error) FILTER (event_type = '{t}') AS \"{t}\"" for t in EVENT_TYPES
    )
    + f" FROM {_rounded} GROUP BY name"
)
ORACLES["accuracy_unpivot"] = f"SELECT name, event_type, rel_error FROM {_rounded}"
ORACLES["dataset_sizes"] = " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS n_rows FROM {t}"
    for t in ("events", "lineitem", "orders", "customer", "documents")
)

# -- streams: the batch answer over the windows the watermark closed ----------

_ms = (
    f"(SELECT event_type AS key, ts_us // 1000 * 1000 AS ts_us, {mix('cents')} AS h FROM {EVENTS})"
)
_stream_all = windowed(_ms, "key", SIZE_MS, SLIDE_MS, "HLL", 6)
_closed = f"window_end <= (SELECT max(ts_us) FROM {_ms})"
ORACLES["stream_sliding_append"] = ORACLES["stream_sliced_append"] = (
    f"SELECT * FROM {_stream_all} WHERE {_closed}"
)
ORACLES["stream_flush"] = f"SELECT * FROM {_stream_all}"
_wk = "window_start, window_end, key"
ORACLES["stream_update"] = (
    f"SELECT {_wk}, n_items, CASE WHEN x < 60 THEN "
    "CAST(round(60.0 * ln(60.0::DOUBLE / (60 - x))) AS BIGINT) END AS estimate FROM "
    f"(SELECT {_wk}, count(*) AS n_items, count(DISTINCT h % 60) AS x FROM "
    f"{windows(_ms, SIZE_MS * 1000, SLIDE_MS * 1000)} GROUP BY {_wk})"
)
ORACLES["stream_dedup"] = (
    "SELECT DISTINCT ts_us // 86400000000 * 86400000000 AS window_start, "
    "ts_us // 86400000000 * 86400000000 + 86400000000 AS window_end, event_type AS key, "
    f"cents AS value FROM {EVENTS}"
)
ORACLES["stream_metrics"] = (
    f"SELECT * FROM {_with_metadata(_ms, 'key', 'ts_us // 1000', _stream_all)} WHERE {_closed}"
)

_buffer_windows = windows(_ms, SIZE_MS * 1000, BUFFER_SLIDE_MS * 1000)
for _name, (_alg, _params) in BUFFERED.items():
    ORACLES[_name] = f"SELECT * FROM {estimate(_alg, _buffer_windows, _wk, _params)} WHERE {_closed}"
ORACLES["stream_upsert"] = (
    f"SELECT {_wk}, n_items, estimate FROM {estimate('KMV', _buffer_windows, _wk, {'k': 16})} JOIN "
    f"(SELECT {_wk}, count(*) AS n_items FROM {_buffer_windows} GROUP BY {_wk}) USING ({_wk})"
)
_halves = (
    "(SELECT ms, cents, ms < lo + (hi - lo) // 2 + 1 AS early FROM "
    "(SELECT ts_us // 1000 AS ms, cents, min(ts_us // 1000) OVER () AS lo, "
    f"max(ts_us // 1000) OVER () AS hi FROM {EVENTS}))"
)
_hour = 3_600_000
_late = (
    f"(SELECT *, (ms // {_hour} + 1) * {_hour} AS ends, early AND ms % 10 = 0 AS held FROM {_halves})"
)
_marks = (
    "(SELECT max(ms) FILTER (early AND NOT held) - 10 AS middle, max(ms) - 10 AS final "
    f"FROM {_late})"
)
ORACLES["stream_late_rows"] = (
    "SELECT count(*) AS n_input, count(*) FILTER (held AND ends <= middle) AS n_late, "
    "count(*) FILTER (ends <= final AND NOT (held AND ends <= middle)) AS n_closed "
    f"FROM {_late}, {_marks}"
)
ORACLES["stream_batch_metrics"] = (
    "SELECT count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS total, min(ms) AS first_ms, "
    f"max(ms) AS last_ms FROM {_halves} GROUP BY early"
)
ORACLES["stream_dedup_within"] = f"SELECT DISTINCT event_type AS key, cents AS value FROM {EVENTS}"


def _fast_windows(factor: int, key: str, name: str, size_ms: int, slide_ms: int) -> str:
    at = f"(ts_us // 1000 * 1000) // {factor}"
    rows = f"(SELECT {key} AS {name}, {at} AS ts_us, {mix('cents')} AS h FROM {EVENTS})"
    found = windowed(rows, name, size_ms, slide_ms, "HLL", 4)
    return f"SELECT * FROM {found} WHERE window_end <= (SELECT max(ts_us) // 1000 * 1000 FROM {rows})"


ORACLES["stream_fine"] = _fast_windows(3_600_000, "event_type", "key", 2, 1)
ORACLES["stream_by_timestamp"] = _fast_windows(
    3600, "(ts_us // 1000 * 1000) // 3600 // 1000", "fast_ms", 1000, 500
)
