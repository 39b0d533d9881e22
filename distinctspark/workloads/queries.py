"""Every operator as a query over the given tables.

Each function takes (spark, table folder) and gives a DataFrame.  Times come
out as epoch microseconds or milliseconds, so results do not depend on the
session time zone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from distinctspark.functions import hashing, sizing
from distinctspark.functions.scalars import epoch_micros
from distinctspark.operators import native
from distinctspark.operators.bloom import BloomFilter, bloom_sizing
from distinctspark.operators.cte import CountThenEstimate
from distinctspark.operators.exact import exact_distinct, item_count
from distinctspark.operators.kmv import kmv_overlap, kmv_overlap_pairs
from distinctspark.operators.linear import linear_counting_sized
from distinctspark.operators.packed import BlockedBloom
from distinctspark.plans import accuracy, reports
from distinctspark.plans.novelty import novelty_flag
from distinctspark.plans.registry import approx_distinct, make_sketch, sketch_state
from distinctspark.plans.windows import flat_window, windowed_distinct
from distinctspark.session import materialize, new_path
from distinctspark.sources import events as ev
from distinctspark.sources import measurements as ms
from distinctspark.sources.states import read_state, write_state
from distinctspark.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOUR_MS = 3_600_000
#: Sliding windows of the events queries: 20 slides per window.
SIZE_MS, SLIDE_MS = 10 * HOUR_MS, HOUR_MS // 2


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with epoch times and the value as hundredths."""
    raw = table(spark, folder, "events")
    us = epoch_micros(F.col("ts"))
    return raw.withColumns({"ts_us": us, "cents": ev.scaled_value(F.col("value"))})


# -- exact -------------------------------------------------------------------


@query
def exact_distinct_query(spark, folder):
    return exact_distinct(lineitem(spark, folder), ["l_returnflag"], "l_partkey")


@query
def exact_distinct_users(spark, folder):
    return exact_distinct(events(spark, folder), ["event_type"], "user_id")


@query
def exact_distinct_texts(spark, folder):
    return exact_distinct(table(spark, folder, "documents"), ["lang"], "text")


@query
def item_count_query(spark, folder):
    return item_count(lineitem(spark, folder), ["l_returnflag", "l_linestatus"])


# -- one estimate per key ----------------------------------------------------

#: name -> (table, keys, value, algorithm, parameters)
ESTIMATES: dict[str, tuple] = {
    "loglog": ("lineitem", ["l_returnflag"], "l_orderkey", "LL", {"p": 10}),
    "loglog_eps": ("lineitem", ["l_returnflag"], "l_orderkey", "LL", {"error": 0.05}),
    "adaptive_counting": ("lineitem", ["l_returnflag"], "l_orderkey", "AC", {"p": 14}),
    "adaptive_counting_full": ("lineitem", ["l_returnflag"], "l_orderkey", "AC", {"p": 8}),
    "hyperloglog": ("lineitem", ["l_returnflag"], "l_orderkey", "HLL", {"p": 12}),
    "hyperloglog_eps": ("lineitem", ["l_returnflag"], "l_orderkey", "HLL", {"error": 0.02}),
    "hyperloglog_text": ("documents", ["lang"], "text", "HLL", {"p": 12, "hash": "md5"}),
    "hllpp_sparse": ("lineitem", ["l_returnflag"], "l_orderkey", "HLLP", {"p": 16, "sp": 22}),
    "hllpp_bias": (
        "lineitem", ["l_returnflag"], "l_orderkey", "HLLP", {"p": 11, "sp": 16, "bias": True},
    ),
    "hllpp_dense": ("lineitem", ["l_returnflag"], "l_orderkey", "HLLP", {"p": 10, "sp": 16}),
    "linear_counting": ("orders", ["o_orderpriority"], "o_custkey", "LC", {"bits": 1 << 16}),
    "linear_counting_packed": (
        "orders", ["o_orderpriority"], "o_custkey", "LCP", {"bits": 1 << 16},
    ),
    "bloom_blocked": ("orders", ["o_orderpriority"], "o_custkey", "BFB", {"blocks": 8, "k": 5}),
    "flajolet_martin": ("events", ["event_type"], "user_id", "FM", {"groups": 3, "hashes": 3}),
    "flajolet_martin_eps": ("events", ["event_type"], "user_id", "FM", {"error": 0.125}),
    "kmv": ("lineitem", ["l_returnflag"], "l_orderkey", "KMV", {"k": 1024}),
    "kmv_eps": ("lineitem", ["l_returnflag"], "l_orderkey", "KMV", {"error": 0.05}),
    "bloom_swamidass": (
        "orders", ["o_orderpriority"], "o_custkey", "BF", {"bits": 1 << 18, "k": 5},
    ),
    "bloom_papapetrou": (
        "orders", ["o_orderpriority"], "o_custkey", "BF",
        {"bits": 1 << 18, "k": 5, "formula": "papapetrou"},
    ),
    "bjkst": (
        "lineitem", ["l_returnflag"], "l_partkey", "BJKST",
        {"tries": 100, "set_size": 10, "error": 0.3},
    ),
    "bjkst_vote": (
        "lineitem", ["l_returnflag"], "l_partkey", "BJKST",
        {"tries": 25, "set_size": 10, "error": 0.3, "combine_by": "vote"},
    ),
    "bjkst_eps": ("lineitem", ["l_returnflag"], "l_orderkey", "BJKST", {"error": 0.5}),
    "count_then_estimate": (
        "lineitem", ["l_quantity"], "l_orderkey", "CTE", {"tip": 1150, "p": 14},
    ),
}


def _estimate(name: str) -> Query:
    source, keys, value, alg, params = ESTIMATES[name]
    options = {"hash": "mix"} | params

    def run(spark, folder):
        found = approx_distinct(table(spark, folder, source), keys, value, alg, **options)
        return found.select(*keys, "estimate")

    return run


QUERIES.update({name: _estimate(name) for name in ESTIMATES})


@query
def linear_counting_1pct(spark, folder):
    keys = ["o_orderpriority"]
    found = linear_counting_sized(orders(spark, folder), keys, "o_custkey", hash="mix")
    return found.select(*keys, "lc_bits", "estimate")


@query
def linear_counting_eps(spark, folder):
    keys = ["o_orderpriority"]
    found = linear_counting_sized(orders(spark, folder), keys, "o_custkey", 0.05, "mix")
    return found.select(*keys, "lc_bits", "estimate")


@query
def lc_utilisation(spark, folder):
    """Small counters, so that some groups saturate."""
    keys = ["o_orderstatus", "o_orderpriority"]
    found = approx_distinct(
        orders(spark, folder), keys, "o_custkey", "LC", hash="mix", bits=1 << 8
    )
    share = F.round("utilisation", 6).alias("utilisation")
    return found.select(*keys, "n_set", "estimate", share, "saturated")


# -- built-in sketches -------------------------------------------------------


@query
def hllpp_builtin(spark, folder):
    return native.hllpp_builtin(lineitem(spark, folder), ["l_returnflag"], "l_orderkey")


@query
def hll_sketch_native(spark, folder):
    """Per (flag, status) sketches merged to one per flag."""
    state = native.hll_state(
        lineitem(spark, folder), ["l_returnflag", "l_linestatus"], "l_orderkey"
    )
    return native.hll_lower(native.hll_merge(state, ["l_returnflag"]))


@query
def theta_native(spark, folder):
    state = native.theta_state(
        lineitem(spark, folder), ["l_returnflag", "l_linestatus"], "l_orderkey"
    )
    return native.theta_overlap(state, ["l_returnflag"])


@query
def bitmap_native(spark, folder):
    return native.bitmap_exact(lineitem(spark, folder), ["l_returnflag"], "l_orderkey")


@query
def null_only_keys(spark, folder):
    """Flag R has no values: every method gives it 0, as COUNT(DISTINCT) does."""
    rows = lineitem(spark, folder).withColumn(
        "value", F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))
    )
    found = [
        approx_distinct(rows, ["l_returnflag"], "value", alg, hash="mix", **params).select(
            F.lit(alg).alias("alg"), "l_returnflag", "estimate"
        )
        for alg, params in DISPATCH.items()
    ]
    return functools.reduce(DataFrame.unionByName, found)


# -- Bloom -------------------------------------------------------------------


@query
def bloom_sizing_query(spark, folder):
    """Filter size per priority for as many percent of false positives as its leading digit."""
    groups = exact_distinct(orders(spark, folder), ["o_orderpriority"], "o_custkey")
    percent = F.substring("o_orderpriority", 1, 1).cast("int")
    picked = groups.withColumn("target", F.round(percent / 100.0, 2))
    sized = bloom_sizing(picked, "n_distinct", "target")
    return sized.select(
        "o_orderpriority", "n_distinct", "target", "bits_per_element", "k", "bits",
        F.round("fpp", 9).alias("fpp"),
    )


def _semi_filter(spark, folder, sketch: BloomFilter) -> DataFrame:
    building = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    state = sketch.state(building, [], "c_custkey")
    kept = sketch.might_contain(
        orders(spark, folder).select("o_orderkey", "o_custkey"), "o_custkey", state
    )
    return kept.select("o_orderkey", "o_custkey")


@query
def bloom_semi_filter(spark, folder):
    return _semi_filter(spark, folder, BloomFilter(hash="mix", bits=1 << 14, k=3))


@query
def bloom_semi_filter_wide(spark, folder):
    """A filter too large to embed: joined instead."""
    return _semi_filter(spark, folder, BloomFilter(hash="mix", bits=1 << 24, k=4))


@query
def bloom_blocked_semi(spark, folder):
    """A filter of 2^31 bits, as the few blocks that hold anything, joined by block."""
    sketch = BlockedBloom(hash="mix", blocks=1 << 16, k=6)
    building = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    state = materialize(sketch.state(building, [], "c_custkey"), "filter")
    rows = orders(spark, folder).select("o_orderkey", "o_custkey")
    return sketch.might_contain(rows, "o_custkey", state).select("o_orderkey", "o_custkey")


# -- merging states ----------------------------------------------------------

MERGES: dict[str, tuple] = {
    "merge_loglog": ("LL", "l_orderkey", {"p": 10}),
    "merge_adaptive": ("AC", "l_orderkey", {"p": 14}),
    "merge_hll": ("HLL", "l_orderkey", {"p": 12}),
    "merge_hllpp": ("HLLP", "l_orderkey", {"p": 10, "sp": 16}),
    "merge_hllpp_bias": ("HLLP", "l_orderkey", {"p": 11, "sp": 16, "bias": True}),
    "merge_lc_packed": ("LCP", "l_orderkey", {"bits": 1 << 18}),
    "merge_bloom_blocked": ("BFB", "l_partkey", {"blocks": 4, "k": 5}),
    "merge_lc": ("LC", "l_orderkey", {"bits": 1 << 18}),
    "merge_fm": ("FM", "l_partkey", {"groups": 3, "hashes": 3}),
    "merge_bloom": ("BF", "l_partkey", {"bits": 1 << 18, "k": 5}),
    "merge_kmv": ("KMV", "l_orderkey", {"k": 1024}),
    "merge_bjkst": ("BJKST", "l_partkey", {"tries": 9, "set_size": 10, "error": 0.3}),
    "merge_cte": ("CTE", "l_orderkey", {"tip": 1000, "p": 14}),
}


def _merge(name: str) -> Query:
    """States per (flag, status), stored, reloaded, merged to one per flag."""
    alg, value, params = MERGES[name]
    fine, coarse = ["l_returnflag", "l_linestatus"], ["l_returnflag"]

    def run(spark, folder):
        sketch = make_sketch(alg, hash="mix", **params)
        path = new_path(spark, "state")
        write_state(sketch.state(lineitem(spark, folder), fine, value), path)
        stored = read_state(spark, path)
        return sketch.estimate(sketch.merge([stored], coarse), coarse).select(
            *coarse, "estimate"
        )

    return run


QUERIES.update({name: _merge(name) for name in MERGES})


@query
def merge_hllpp_mixed(spark, folder):
    """Sparse and dense states, stored, merged in any mix: what came in, what came out."""
    sketch = make_sketch("HLLP", hash="mix", p=11, sp=18)
    fine, coarse = ["l_linenumber", "l_returnflag"], ["l_linenumber"]
    path = new_path(spark, "state")
    write_state(sketch.state(lineitem(spark, folder), fine, "l_orderkey"), path)
    stored = read_state(spark, path)
    parts = stored.groupBy(*fine).agg(F.max("form").alias("form")).groupBy(*coarse).agg(
        F.count_if(F.col("form") == 0).alias("n_sparse"),
        F.count_if(F.col("form") == 1).alias("n_dense"),
    )
    merged = materialize(sketch.merge([stored], coarse), "merged")
    size = merged.groupBy(*coarse).agg(
        (F.max("form") == 1).alias("is_dense"),
        (F.count(F.lit(1)) <= 1 << sketch.p).alias("is_bounded"),
    )
    return sketch.estimate(merged, coarse).join(parts, coarse).join(size, coarse)


def _status_overlap(spark, folder) -> DataFrame:
    """Both statuses' orders within each flag."""
    keys = ["l_returnflag"]
    state = sketch_state(
        lineitem(spark, folder), [*keys, "l_linestatus"], "l_orderkey", "KMV", hash="mix", k=1024
    )
    found = kmv_overlap(state, 1024, ["l_linestatus"], keys)
    return found.withColumn("jaccard", F.round("jaccard", 6))


@query
def kmv_set_overlap(spark, folder):
    return _status_overlap(spark, folder)


@query
def kmv_overlap_appended(spark, folder):
    """The same from states that a re-run has appended twice."""
    keys, member = ["l_returnflag"], ["l_linestatus"]
    path = new_path(spark, "state")
    state = sketch_state(
        lineitem(spark, folder), [*keys, *member], "l_orderkey", "KMV", hash="mix", k=1024
    )
    write_state(state, path)
    write_state(state, path)
    found = kmv_overlap(read_state(spark, path), 1024, member, keys)
    return found.withColumn("jaccard", F.round("jaccard", 6))


@query
def kmv_union(spark, folder):
    return _status_overlap(spark, folder).select("l_returnflag", "union_estimate")


@query
def kmv_jaccard(spark, folder):
    return _status_overlap(spark, folder).select("l_returnflag", "jaccard")


@query
def kmv_intersection(spark, folder):
    return _status_overlap(spark, folder).select("l_returnflag", "intersection_estimate")


@query
def kmv_pair_overlap(spark, folder):
    """Each flag's orders against those of flag N."""
    flags = lineitem(spark, folder).select(F.col("l_returnflag").alias("left")).distinct()
    pairs = flags.where("left <> 'N'").withColumn("right", F.lit("N"))
    state = sketch_state(
        lineitem(spark, folder), ["l_returnflag"], "l_orderkey", "KMV", hash="mix", k=512
    )
    found = kmv_overlap_pairs(state, pairs, 512, "l_returnflag")
    return found.withColumn("jaccard", F.round("jaccard", 6))


# -- windows -----------------------------------------------------------------


def _windowed(spark, folder, **kw) -> DataFrame:
    defaults = {"alg": "HLL", "hash": "mix", "p": 6, "size_ms": SIZE_MS, "slide_ms": SLIDE_MS}
    options = defaults | kw
    if options["alg"] == "EXACT":
        options.pop("p")
    found = windowed_distinct(events(spark, folder), ["event_type"], "user_id", "ts", **options)
    return flat_window(found, epoch_micros)


@query
def sliding_direct(spark, folder):
    return _windowed(spark, folder, strategy="direct")


@query
def sliding_sliced(spark, folder):
    return _windowed(spark, folder, strategy="sliced")


@query
def sliding_exact(spark, folder):
    return _windowed(spark, folder, alg="EXACT", strategy="sliced")


@query
def sliding_exact_intervals(spark, folder):
    return _windowed(spark, folder, alg="EXACT", strategy="intervals")


@query
def sliding_cte(spark, folder):
    """Slices and windows that hold sets up to the tip, registers beyond."""
    return _windowed(spark, folder, alg="CTE", tip=40, p=8)


@query
def sliding_hllpp(spark, folder):
    """Sparse slices that merge into dense windows."""
    return _windowed(spark, folder, alg="HLLP", p=6, sp=14)


@query
def sliding_uneven(spark, folder):
    """A size that is no multiple of the slide: slices of their common divisor."""
    return _windowed(spark, folder, size_ms=10 * HOUR_MS, slide_ms=4 * HOUR_MS)


@query
def tumbling(spark, folder):
    return _windowed(spark, folder, slide_ms=None)


@query
def window_metadata(spark, folder):
    found = _windowed(spark, folder, metadata=True)
    return found.withColumns(
        {c: epoch_micros(F.col(c)) for c in ("first_ts", "last_ts")}
    )


def _compressed(spark, folder, factor: int) -> DataFrame:
    """Events with time running ``factor`` times faster."""
    fast = F.timestamp_micros(F.floor(F.col("ts_us") / factor))
    return events(spark, folder).withColumn("fast_ts", fast)


@query
def sliding_fine(spark, folder):
    """2 ms windows every 1 ms over compressed time."""
    found = windowed_distinct(
        _compressed(spark, folder, 3_600_000), ["event_type"], "user_id", "fast_ts",
        2, 1, "HLL", hash="mix", p=4,
    )
    return flat_window(found, F.unix_micros)


@query
def sliding_by_timestamp(spark, folder):
    """1 s windows every 500 ms, keyed by the timestamp field."""
    fast = _compressed(spark, folder, 3600)
    fast = fast.withColumn("ts_ms", F.unix_millis("fast_ts"))
    found = windowed_distinct(
        fast, ["ts_ms"], "user_id", "fast_ts", 1000, 500, "HLL", hash="mix", p=4
    )
    return flat_window(found, F.unix_micros)


# -- novelty -----------------------------------------------------------------


@query
def novelty_flag_query(spark, folder):
    found = novelty_flag(
        events(spark, folder), ["event_type"], "cents", ["ts_us", "event_id"],
        "HLL", p=8, hash="mix",
    )
    return found.select("event_id", "event_type", "is_novel")


@query
def novelty_exact(spark, folder):
    found = novelty_flag(
        events(spark, folder), ["event_type"], "cents", ["ts_us", "event_id"],
        "EXACT", hash="mix",
    )
    return found.select("event_id", "event_type", "is_novel")


@query
def novelty_lc(spark, folder):
    found = novelty_flag(
        events(spark, folder), ["event_type"], "cents", ["ts_us", "event_id"],
        "LC", bits=4096, hash="mix",
    )
    return found.select("event_id", "event_type", "is_novel")


@query
def novelty_kmv(spark, folder):
    found = novelty_flag(
        events(spark, folder), ["event_type"], "cents", ["ts_us", "event_id"],
        "KMV", k=64, hash="mix",
    )
    return found.select("event_id", "event_type", "is_novel")


@query
def novelty_fm(spark, folder):
    found = novelty_flag(
        events(spark, folder), ["event_type"], "cents", ["ts_us", "event_id"],
        "FM", groups=3, hashes=3, hash="mix",
    )
    return found.select("event_id", "event_type", "is_novel")


@query
def novelty_bloom(spark, folder):
    found = novelty_flag(
        events(spark, folder), ["event_type"], "cents", ["ts_us", "event_id"],
        "BF", bits=1 << 13, k=4, hash="mix",
    )
    return found.select("event_id", "event_type", "is_novel")


def _novel(spark, folder, alg: str, **params) -> DataFrame:
    found = novelty_flag(
        events(spark, folder), ["event_type"], "cents", ["ts_us", "event_id"],
        alg, hash="mix", **params,
    )
    return found.select("event_id", "event_type", "is_novel")


@query
def novelty_hllpp(spark, folder):
    """Sparse up to 192 indexes a key, registers after."""
    return _novel(spark, folder, "HLLP", p=8, sp=14)


@query
def novelty_cte(spark, folder):
    return _novel(spark, folder, "CTE", tip=150, p=8)


@query
def novelty_cte_lc(spark, folder):
    return _novel(spark, folder, "CTE", tip=150, p=9, estimator="LC")


@query
def novelty_bjkst(spark, folder):
    return _novel(spark, folder, "BJKST", tries=3, set_size=10, error=0.4)


# -- event sources -----------------------------------------------------------


def _csv_events(spark, folder) -> DataFrame:
    """The events table as (ts_ms, key, value) text fields."""
    return events(spark, folder).select(
        F.floor(F.col("ts_us") / 1000).alias("ts_ms"),
        F.col("event_type").alias("key"),
        "value",
    )


@query
def csv_roundtrip(spark, folder):
    """Written as header-less CSV, read back, counted per key."""
    path = new_path(spark, "events-csv")
    ev.write_events(_csv_events(spark, folder), path)
    back = ev.read_events(spark, path)
    return back.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("value").alias("n_distinct"),
        F.sum("value").alias("total"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
    )


@query
def duration_cut(spark, folder):
    """The first ten days of events."""
    cut = ev.limit_duration(events(spark, folder), "ts", F.expr("INTERVAL 10 DAYS"))
    return cut.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us")
    )


@query
def event_rejects(spark, folder):
    """What a CSV of events with broken fields loses, and what it lacks."""
    path = new_path(spark, "events-raw")
    n = F.col("event_id")
    broken = events(spark, folder).select(
        F.when(n % 7 == 0, F.lit("soon")).otherwise(F.floor(F.col("ts_us") / 1000).cast("string")),
        F.when(n % 5 != 0, F.col("event_type")),
        F.when(n % 11 == 0, F.lit("much")).when(n % 13 != 0, F.col("value").cast("string")),
    )
    broken.write.option("header", "false").csv(path)
    return ev.rejected_rows(ev.read_raw(spark, path))


@query
def fill_missing(spark, folder):
    """Every row whose value is below 1 loses its key or its value first."""
    short = F.col("value") < 1
    odd = F.col("event_id") % 2 == 1
    holes = events(spark, folder).select(
        "event_id",
        F.when(~(short & odd), F.col("event_type")).alias("key"),
        F.when(~(short & ~odd), F.col("cents")).alias("value"),
    )
    filled = ev.fill_missing(holes, seed=7)
    return filled.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values")
    )


@query
def synthetic_events(spark, folder):
    """Five pseudo-random values of one key per event time."""
    made = ev.synthetic_events(events(spark, folder), "event_id", "ts_us", seed=42)
    return made.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_distinct")
    )


# -- dispatch ----------------------------------------------------------------

DISPATCH: dict[str, dict] = {
    "EXACT": {},
    "LL": {"p": 8},
    "AC": {"p": 12},
    "HLL": {"p": 10},
    "HLLP": {"p": 10, "sp": 16},
    "LC": {"bits": 1 << 14},
    "FM": {"groups": 3, "hashes": 3},
    "KMV": {"k": 256},
    "BF": {"bits": 1 << 16, "k": 4},
    "BJKST": {"tries": 5, "set_size": 10, "error": 0.3},
    "CTE": {"tip": 100, "p": 12},
}


@query
def alg_dispatch(spark, folder):
    """All codes through one call, over one reading of the table."""
    methods = {alg: make_sketch(alg, hash="mix", **p) for alg, p in DISPATCH.items()}
    keys = ["l_returnflag"]
    base = accuracy.distinct_table(lineitem(spark, folder), keys, "l_partkey", methods)
    return accuracy.estimates_of(base, keys, methods).withColumnRenamed("name", "alg")


@query
def prehashed_sketch(spark, folder):
    """The caller's own 60-bit hash column goes in as it is."""
    rows = lineitem(spark, folder).withColumn(
        "line", F.concat_ws("-", "l_orderkey", "l_linenumber")
    )
    rows = rows.withColumn("own_hash", hashing.hash60("line", "md5"))
    state = sketch_state(rows, ["l_returnflag"], "own_hash", "HLL", prehashed=True, p=11)
    sketch = make_sketch("HLL", p=11)
    return sketch.estimate(state, ["l_returnflag"])


#: One seeded hash of the family, number 3.
COEFFICIENTS = dict(zip("abcdef", hashing.family_coefficients(3), strict=True))


@query
def hash_family(spark, folder):
    """Hashes, seeded hashes and bit ranks, summarised per flag."""
    rows = lineitem(spark, folder).select(
        "l_returnflag",
        hashing.hash60("l_orderkey", "mix").alias("mixed"),
        hashing.hash60("l_orderkey", "md5").alias("text"),
        *[F.lit(c).cast("long").alias(n) for n, c in COEFFICIENTS.items()],
    )
    rows = rows.withColumn("seeded", hashing.seeded_hash("mixed"))
    positions = hashing.bloom_positions(F.col("mixed"), 4, 1009)
    return rows.groupBy("l_returnflag").agg(
        F.min("mixed").alias("min_mix"),
        F.max("text").alias("max_md5"),
        F.min("seeded").alias("min_seeded"),
        F.sum(hashing.leading_rank(F.col("mixed"), 60)).alias("leading"),
        F.sum(hashing.trailing_zeros(F.col("seeded"))).alias("trailing"),
        F.sum(hashing.lowest_unset_bit(F.col("mixed"))).alias("unset"),
        F.sum(F.element_at(positions, 4)).alias("positions"),
    )


@query
def hash_native(spark, folder):
    """Spark's own 32- and 64-bit hashes over the same column."""
    return lineitem(spark, folder).groupBy("l_returnflag").agg(
        F.min(F.hash("l_orderkey")).alias("min_hash32"),
        F.min(F.xxhash64(F.lit(9001), "l_orderkey")).alias("min_hash64"),
    )


@query
def size_rules(spark, folder):
    """Sketch sizes for each error target (the discounts in use)."""
    errors = lineitem(spark, folder).where("l_discount > 0").select("l_discount").distinct()
    rules = sizing.sizes_for_error(F.col("l_discount"))
    return errors.select("l_discount", *[c.cast("long").alias(n) for n, c in rules.items()])


# -- measurements ------------------------------------------------------------


def metric_rows(spark, folder) -> DataFrame:
    """Raw (run, metric_key, field, val) rows made from the events.

    Event i is an insertion, a query or a throughput record by i mod 3, timed
    from its own time and value.
    """
    e = events(spark, folder)
    third = F.col("event_id") % 3
    stamp, later = F.col("ts_us"), F.col("ts_us") + F.col("cents")

    def pair(name: str, value) -> F.Column:
        return F.struct(F.lit(name).alias("field"), value.cast("long").alias("val"))

    fields = (
        F.when(third == 0, F.array(pair("insertion_start", stamp), pair("insertion_end", later)))
        .when(
            third == 1,
            F.array(
                pair("query_start", stamp),
                pair("query_end", later),
                pair("window_end_time", stamp),
            ),
        )
        .otherwise(
            F.array(
                pair("window_count", F.col("user_id") % 50 + 1),
                pair("out_time", later),
                pair("window_end", stamp),
            )
        )
    )
    prefix = F.when(third == 0, F.lit("")).otherwise(F.lit("w"))
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "aggregate").otherwise("slicing").alias("approach"),
        F.upper("event_type").alias("algorithm"),
        (F.lit(100_000) * (1 + F.col("user_id") % 3)).cast("string").alias("tps"),
        F.lit("normal").alias("dist"),
        F.lit("1").alias("run"),
        F.concat(
            prefix, stamp.cast("string"), F.lit("|"), "event_type", F.lit("|"), "event_id"
        ).alias("metric_key"),
        F.explode(fields).alias("f"),
    ).select("*", "f.field", "f.val").drop("f")


RUN = ["approach", "algorithm", "tps", "dist", "run"]


def _records(spark, folder) -> DataFrame:
    return ms.classify_metrics(ms.assemble_metrics(metric_rows(spark, folder), RUN))


@query
def metric_assembly(spark, folder):
    return ms.split_metric_key(_records(spark, folder))


def _stored_records(spark, folder) -> DataFrame:
    """All records through result files, with the run parsed from their names."""
    path = new_path(spark, "measurements")
    ms.write_measurements(_records(spark, folder), path)
    schema = "metric_key string, " + ", ".join(f"{f} long" for f in ms.FIELDS)
    return ms.read_measurements(spark, path, schema)


def _rounded(summary: DataFrame) -> DataFrame:
    return summary.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query
def latency_summary(spark, folder):
    records = _stored_records(spark, folder).where(F.col("metric") == ms.QUERY)
    return _rounded(reports.latency_summary(records, "query_start", "query_end"))


@query
def insertion_summary(spark, folder):
    records = _stored_records(spark, folder).where(F.col("metric") == ms.INSERTION)
    return _rounded(reports.latency_summary(records, "insertion_start", "insertion_end"))


@query
def throughput_cdf(spark, folder):
    records = _records(spark, folder).where(F.col("metric") == ms.THROUGHPUT)
    found = reports.throughput_cdf(records, RUN)
    return found.withColumn("cdf", F.round("cdf", 9))


@query
def append_measurements(spark, folder):
    """Records of two kinds in one table, counted by which fields they have."""
    records = _records(spark, folder)
    parts = [
        records.where(F.col("metric") == ms.QUERY).select(*RUN, "query_start", "query_end"),
        records.where(F.col("metric") == ms.THROUGHPUT).select(*RUN, "out_time", "window_count"),
    ]
    return (
        ms.append_sets(parts)
        .groupBy("approach", "algorithm")
        .agg(
            F.count("query_start").alias("n_query"),
            F.count("window_count").alias("n_throughput"),
            F.sum("window_count").alias("items"),
        )
    )


# -- accuracy ----------------------------------------------------------------

METHODS: dict[str, tuple[str, dict]] = {
    "KMV": ("KMV", {"k": 128}),
    "LogLog": ("LL", {"p": 8}),
    "LinearCounting": ("LC", {"bits": 1 << 13}),
    "HyperLogLog": ("HLL", {"p": 8}),
    "HyperLogLog+": ("HLLP", {"p": 12, "sp": 18}),
    "FM": ("FM", {"groups": 3, "hashes": 3}),
    "BJKST": ("BJKST", {"tries": 5, "set_size": 10, "error": 0.3}),
    "AdaptiveCounting": ("AC", {"p": 11}),
    "BloomFilter": ("BF", {"bits": 1 << 14, "k": 4}),
    "CountThenEstimate": ("CTE", {"tip": 1000, "p": 12}),
}


def _report(spark, folder) -> DataFrame:
    methods = {name: make_sketch(alg, hash="mix", **p) for name, (alg, p) in METHODS.items()}
    return accuracy.accuracy_report(events(spark, folder), ["event_type"], "cents", methods)


def _round_error(df: DataFrame) -> DataFrame:
    return df.withColumn("rel_error", F.round("rel_error", 6))


@query
def accuracy_report(spark, folder):
    return _round_error(_report(spark, folder))


@query
def accuracy_rank(spark, folder):
    return _round_error(accuracy.accuracy_rank(_report(spark, folder), ["event_type"]))


def _pivoted(spark, folder) -> tuple[DataFrame, list[str]]:
    types = accuracy.pivot_values(table(spark, folder, "events"), "event_type")
    report = _round_error(_report(spark, folder))
    return accuracy.accuracy_pivot(report, "event_type", types), types


@query
def accuracy_pivot(spark, folder):
    return _pivoted(spark, folder)[0]


@query
def accuracy_unpivot(spark, folder):
    wide, types = _pivoted(spark, folder)
    return accuracy.accuracy_unpivot(wide, "event_type", types)


@query
def dataset_sizes(spark, folder):
    names = ("events", "lineitem", "orders", "customer", "documents")
    return ms.dataset_sizes(spark, [f"{folder}/{n}.parquet" for n in names])


# -- streams -----------------------------------------------------------------

STREAM_STEPS = 2


def _drained(
    spark,
    folder,
    build,
    delay: str | None = "0 seconds",
    held: Callable[[Column, int], Column] | None = None,
    **how,
) -> runs.Drained:
    """Feed the events as CSV in time order, one half of the time range per step.

    Rows of the first half that ``held`` (of the time and the middle) names come with the second.
    """
    path = new_path(spark, "stream-in")
    rows = _csv_events(spark, folder)
    lo, hi = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    width = (hi - lo) // STREAM_STEPS + 1
    at, middle = F.col("ts_ms"), lo + width
    late = held(at, middle) & (at < middle) if held else F.lit(False)

    def feed(step: int) -> None:
        start = lo + step * width
        own = (at >= start) & (at < start + width)
        chunk = rows.where(own & ~late if step == 0 else own | late if step == 1 else own)
        chunk.write.mode("append").option("header", "false").csv(path)

    def stream(session: SparkSession) -> DataFrame:
        source = ev.stream_events(session, path)
        return build(source.withWatermark("ts", delay) if delay else source)

    return runs.drain(spark, stream, feed, STREAM_STEPS, **how)


def _stream_windows(strategy: str, **extra):
    def build(source: DataFrame) -> DataFrame:
        return windowed_distinct(
            source, ["key"], "value", "ts", SIZE_MS, SLIDE_MS, "HLL", strategy,
            hash="mix", p=6, **extra,
        )

    return build


@query
def stream_sliding_append(spark, folder):
    drained = _drained(spark, folder, _stream_windows("direct"))
    return flat_window(drained.result(), F.unix_micros)


@query
def stream_sliced_append(spark, folder):
    drained = _drained(spark, folder, _stream_windows("sliced"))
    return flat_window(drained.result(), F.unix_micros)


def _fast(source: DataFrame, factor: int) -> DataFrame:
    """A stream with time running ``factor`` times faster, and its watermark."""
    fast = source.withColumn("fast_ts", F.timestamp_micros(F.expr(f"ts_ms * 1000 div {factor}")))
    return fast.withWatermark("fast_ts", "0 seconds")


@query
def stream_fine(spark, folder):
    """2 ms windows every 1 ms over a stream of compressed time."""

    def build(source: DataFrame) -> DataFrame:
        return windowed_distinct(
            _fast(source, 3_600_000), ["key"], "value", "fast_ts", 2, 1, "HLL", hash="mix", p=4
        )

    return flat_window(_drained(spark, folder, build, None).result(), F.unix_micros)


@query
def stream_by_timestamp(spark, folder):
    """1 s windows every 500 ms of a stream keyed by the timestamp field."""

    def build(source: DataFrame) -> DataFrame:
        fast = _fast(source, 3600).withColumn("fast_ms", F.unix_millis("fast_ts"))
        return windowed_distinct(
            fast, ["fast_ms"], "value", "fast_ts", 1000, 500, "HLL", hash="mix", p=4
        )

    return flat_window(_drained(spark, folder, build, None).result(), F.unix_micros)


#: Slide of the windows whose state is one bounded buffer each.
BUFFER_SLIDE_MS = 5 * HOUR_MS // 2
BUFFERED: dict[str, tuple[str, dict]] = {
    "stream_kmv": ("KMV", {"k": 16}),
    "stream_bjkst": ("BJKST", {"tries": 5, "set_size": 2, "error": 0.4}),
    "stream_cte": ("CTE", {"tip": 20, "p": 8}),
}


def _buffered(alg: str, params: dict, **how):
    def build(source: DataFrame) -> DataFrame:
        return windowed_distinct(
            source, ["key"], "value", "ts", SIZE_MS, BUFFER_SLIDE_MS, alg, hash="mix",
            **params, **how,
        )

    return build


def _stream_buffer(name: str) -> Query:
    def run(spark, folder):
        drained = _drained(spark, folder, _buffered(*BUFFERED[name]))
        return flat_window(drained.result(), F.unix_micros)

    return run


QUERIES.update({name: _stream_buffer(name) for name in BUFFERED})


@query
def stream_upsert(spark, folder):
    """Update mode: late rows fire their windows again, and the sink keeps the newest version.

    A fifth of the rows of eight hours comes with the second half, within the watermark's delay.
    """
    build = _buffered("KMV", {"k": 16}, metadata=True, output_mode="update")
    drained = _drained(
        spark, folder, build, "12 hours",
        lambda at, middle: (at % 5 == 0) & (at >= middle - 8 * HOUR_MS),
        mode="update", sink="upsert",
    )
    found = runs.latest(drained.result(), ["window", "key"])
    return flat_window(found, F.unix_micros).select(
        "window_start", "window_end", "key", "n_items", "estimate"
    )


@query
def stream_late_rows(spark, folder):
    """Hourly windows at a delay of 10 ms: a tenth of the first half comes late."""

    def build(source: DataFrame) -> DataFrame:
        return windowed_distinct(
            source, ["key"], "value", "ts", HOUR_MS, None, "KMV", hash="mix", k=16, metadata=True
        )

    drained = _drained(spark, folder, build, "10 milliseconds", lambda at, _: at % 10 == 0)
    closed = drained.result().agg(F.sum("n_items").alias("n_closed"))
    told = drained.batches().agg(F.sum("n_input").alias("n_input"), F.sum("n_late").alias("n_late"))
    return told.withColumn("n_closed", closed.scalar())


@query
def stream_batch_metrics(spark, folder):
    """What the running query observed of each batch that had rows."""

    def build(source: DataFrame) -> DataFrame:
        seen = source.observe(
            "batch",
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("value").alias("total"),
            F.min("ts_ms").alias("first_ms"),
            F.max("ts_ms").alias("last_ms"),
        )
        return seen.groupBy(F.window("ts", "1 day"), "key").count()

    drained = _drained(spark, folder, build)
    schema = "n_rows long, total long, first_ms long, last_ms long"
    return runs.observed(drained, "batch", schema).drop("batch_id")


@query
def stream_dedup_within(spark, folder):
    """One row per key and value, held for 60 days of event time after the first."""

    def build(source: DataFrame) -> DataFrame:
        return source.dropDuplicatesWithinWatermark(["key", "value"]).select("key", "value")

    return _drained(spark, folder, build, "60 days").result()


@query
def stream_flush(spark, folder):
    """Closed windows from the stream, the open tail from a batch pass over its end."""
    drained = _drained(spark, folder, _stream_windows("sliced"))
    closed = flat_window(drained.result(), F.unix_micros)
    watermark = drained.watermark_ms()
    tail_rows = (
        events(spark, folder)
        .where(F.col("ts") > F.lit(_ntz(watermark - SIZE_MS)).cast("timestamp_ntz"))
        .select(F.col("event_type").alias("key"), F.col("cents").alias("value"), "ts")
    )
    tail = windowed_distinct(
        tail_rows, ["key"], "value", "ts", SIZE_MS, SLIDE_MS, "HLL", hash="mix", p=6
    )
    tail = flat_window(tail, epoch_micros).where(F.col("window_end") > watermark * 1000)
    return closed.unionByName(tail)


def _ntz(epoch_ms: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(epoch_ms / 1000, UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


@query
def stream_update(spark, folder):
    """Every window's latest value: closed ones as emitted, live ones from the state.

    One stateful step per window and key: an item count and a 60-bit linear
    counter folded into one BIGINT.
    """
    bits = 60

    def build(source: DataFrame) -> DataFrame:
        bit = F.pmod(hashing.hash60("value", "mix"), F.lit(bits)).cast("int")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        sliding = F.window("ts", f"{SIZE_MS} milliseconds", f"{SLIDE_MS} milliseconds")
        return source.groupBy(sliding, "key").agg(
            F.count(F.lit(1)).alias("n_items"), F.bit_or(mask).alias("bits")
        )

    drained = _drained(spark, folder, build)
    live = runs.live_state(spark, drained.checkpoint).select(
        "key.window", "key.key", F.col("value.count").alias("n_items"), "value.bit_or"
    )
    latest = drained.result().unionByName(live.withColumnRenamed("bit_or", "bits"))
    unset = F.nullif(F.lit(bits) - F.bit_count("bits"), F.lit(0))
    estimate = F.round(F.lit(float(bits)) * F.ln(F.lit(float(bits)) / unset)).cast("long")
    return flat_window(latest.withColumn("estimate", estimate).drop("bits"), F.unix_micros)


@query
def stream_dedup(spark, folder):
    """First occurrence of each value per day and key, kept while the day is open."""

    def build(source: DataFrame) -> DataFrame:
        daily = source.withColumn("window", F.window("ts", "1 day"))
        return daily.dropDuplicates(["window", "key", "value"]).select("window", "key", "value")

    return flat_window(_drained(spark, folder, build).result(), F.unix_micros)


@query
def stream_metrics(spark, folder):
    """Items and values per closed window, as the stream measured them."""
    drained = _drained(spark, folder, _stream_windows("sliced", metadata=True))
    found = flat_window(drained.result(), F.unix_micros)
    return found.withColumns({c: F.unix_millis(c) for c in ("first_ts", "last_ts")})
