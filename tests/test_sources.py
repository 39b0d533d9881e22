"""Event CSV, missing fields, measurements and their files."""

import pytest
from pyspark.sql import functions as F

from distinctspark.functions.hashing import PRIME, family_coefficients, hash60
from distinctspark.plans import reports
from distinctspark.plans.novelty import novelty_flag
from distinctspark.plans.registry import SKETCHES
from distinctspark.session import new_path
from distinctspark.sources import events as ev
from distinctspark.sources import measurements as ms

LINES = """\
* a comment line
1383451269002,A,22.47
1383451269006,A,18.24
1383451269006,B,18
1383451269050
1383451269060,C,oops
not a time,D,1.0
"""


def write_text(spark, text):
    path = new_path(spark, "text")
    spark.createDataFrame([(text,)], "value string").select(
        F.explode(F.split("value", "\n")).alias("value")
    ).where("value <> ''").coalesce(1).write.text(path)
    return path


def test_read_events(spark):
    rows = ev.read_events(spark, write_text(spark, LINES)).orderBy("ts_ms", "key").collect()
    assert [(r.ts_ms, r.key, r.value) for r in rows] == [
        (1383451269002, "A", 2247),
        (1383451269006, "A", 1824),
        (1383451269006, "B", 1800),
        (1383451269050, None, None),
        (1383451269060, "C", None),
    ]


def test_fill_missing_is_repeatable_and_near_its_mean(spark):
    holes = spark.range(4000).select(
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("value")
    )
    filled = ev.fill_missing(holes, seed=3)
    r = filled.agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd")).first()
    assert abs(r["mean"] - 2000) < 50 and abs(r.sd - 500) < 50
    assert {x.key for x in filled.select("key").distinct().collect()} == {"DUMMY"}
    kept = ev.fill_missing(spark.createDataFrame([("k", 5)], "key string, value long")).first()
    assert (kept.key, kept.value) == ("k", 5)


def test_duration_cut_keeps_the_boundary(spark):
    df = spark.range(10).select(F.timestamp_millis(F.col("id") * 1000).alias("ts"), "id")
    cut = ev.limit_duration(df, "ts", F.expr("INTERVAL 3 SECONDS"))
    assert sorted(r.id for r in cut.collect()) == [0, 1, 2, 3]
    assert ev.limit_duration(df.where("id < 0"), "ts", F.expr("INTERVAL 1 DAY")).count() == 0


def raw_metrics(spark):
    rows = [
        ("10|A|1", "insertion_start", 100), ("10|A|1", "insertion_end", 140),
        ("11|A|2", "insertion_start", 200), ("11|A|2", "insertion_end", 220),
        ("w500|A", "query_start", 7), ("w500|A", "query_end", 19),
        ("w500|A", "window_end_time", 1500),
        ("w900|B", "window_count", 4), ("w900|B", "out_time", 77), ("w900|B", "window_end", 1900),
        ("w901|B", "insertion_start", 4),
    ]
    return spark.createDataFrame(rows, "metric_key string, field string, val long")


def test_assembly_and_classification(spark):
    records = ms.split_metric_key(ms.classify_metrics(ms.assemble_metrics(raw_metrics(spark))))
    got = {r.metric_key: (r.metric, r.event_time, r.key) for r in records.collect()}
    assert got == {
        "10|A|1": ("insertionTime", 10, "A"),
        "11|A|2": ("insertionTime", 11, "A"),
        "w500|A": ("queryTime", 500, "A"),
        "w900|B": ("throughput", 900, "B"),
    }


def test_measurement_files_carry_their_run(spark):
    run = {"approach": "aggregate", "algorithm": "HLL", "tps": "100000", "dist": "normal",
           "run": "1558"}
    records = ms.classify_metrics(ms.assemble_metrics(raw_metrics(spark)))
    records = records.withColumns({k: F.lit(v) for k, v in run.items()})
    path = new_path(spark, "meas")
    ms.write_measurements(records, path)
    schema = "metric_key string, " + ", ".join(f"{f} long" for f in ms.FIELDS)
    back = ms.read_measurements(spark, path, schema)
    assert {tuple(r[p] for p in run) for r in back.collect()} == {tuple(run.values())}
    ins = reports.latency_summary(
        back.where("metric = 'insertionTime'"), "insertion_start", "insertion_end"
    ).first()
    assert (ins.n, ins["mean"], ins["median"]) == (2, 30.0, 30.0)


def test_measurement_files_named_by_run(spark, tmp_path):
    name = "slicing_KMV_500000_sorted_queryTime_1558.csv"
    (tmp_path / name).write_text("query_start,query_end\n1,4\n2,9\n")
    r = ms.read_measurements(spark, str(tmp_path), "query_start long, query_end long")
    row = r.select(*ms.RUN_PARTS).distinct().collect()
    assert [tuple(x) for x in row] == [("slicing", "KMV", "500000", "sorted", "queryTime", "1558")]


def test_run_names_may_hold_underscores(spark, tmp_path):
    name = "aggregate_HLL_100000_left_skewed_insertionTime_77.csv"
    (tmp_path / name).write_text("insertion_start,insertion_end\n1,4\n")
    r = ms.read_measurements(spark, str(tmp_path), "insertion_start long, insertion_end long")
    row = r.select(*ms.RUN_PARTS).first()
    assert tuple(row) == ("aggregate", "HLL", "100000", "left_skewed", "insertionTime", "77")


def test_appending_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "x int, z int")
    rows = sorted(map(tuple, ms.append_sets([a, b]).select("x", "y", "z").collect()))
    assert rows == [(1, 2, None), (3, None, 4)]


def test_novelty_matches_a_replay(spark):
    df = spark.range(600).select(
        "id", (F.col("id") % 2).alias("key"), (F.col("id") * 7 % 101).alias("value")
    )
    flagged = novelty_flag(df, ["key"], "value", ["id"], "EXACT").orderBy("id").collect()
    seen = set()
    for r in flagged:
        assert r.is_novel == ((r.key, r.value) not in seen)
        seen.add((r.key, r.value))


def test_kmv_novelty_matches_a_replay(spark):
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("key"),  # and a NULL key
        (F.col("id") * 7 % 1009).alias("value"),
    )
    flagged = novelty_flag(df, ["key"], "value", ["id"], "KMV", k=16, hash="mix")
    hashes = {r.value: r.h for r in df.select("value", hash60("value", "mix").alias("h")).collect()}
    smallest = {}
    for r in flagged.orderBy("id").collect():
        held = smallest.setdefault(r.key, [])
        h = hashes[r.value]
        novel = h not in held and (len(held) < 16 or h < held[-1])
        if novel:
            smallest[r.key] = sorted([*held, h])[:16]
        assert r.is_novel == novel, r


def replayed(rows, key, offer):
    """Row ids that ``offer(state of the key, hash)`` calls novel, in order."""
    states, novel = {}, set()
    for r in rows:
        if offer(states.setdefault(r[key], {}), r["h"]):
            novel.add(r["id"])
    return novel


def ranked(h, p):
    rest = h & ((1 << (60 - p)) - 1)
    return h >> (60 - p), 60 - p + 1 - rest.bit_length()


def offer_register(state, h, p):
    bucket, rank = ranked(h, p)
    if rank <= state.get((p, bucket), 0):
        return False
    state[(p, bucket)] = rank
    return True


def offer_hllpp(state, h):
    """p 4, sp 9: sparse up to 12 indexes."""
    dense = offer_register(state, h, 4)
    tipped = state.get("tipped", False)
    sparse = offer_register(state, h, 9)
    if sum(1 for k in state if k[0] == 9) > 12:
        state["tipped"] = True
    return dense if tipped else sparse


def offer_cte(state, h):
    """tip 20, p 4."""
    dense, tipped = offer_register(state, h, 4), state.get("tipped", False)
    held = state.setdefault("held", set())
    new = h not in held
    held.add(h)
    if len(held) > 20:
        state["tipped"] = True
    return dense if tipped else new


def offer_bjkst(state, h):
    """tries 2, buffer int(3 / 0.5^2) = 12."""
    changed = False
    for t in range(2):
        a, b, c, d, e, f = family_coefficients(t)
        high, low = h >> 30, h & (1 << 30) - 1
        x = (a * high + b * low + c) % PRIME & (1 << 30) - 1
        x = x << 30 | (d * high + e * low + f) % PRIME & (1 << 30) - 1
        z = 60 if x == 0 else (x & -x).bit_length() - 1
        level, held = state.setdefault(t, [0, {}])
        if z >= level and h not in held:
            held[h] = z
            changed = True
            while len(held) > 12:
                state[t][0] += 1
                for other in [k for k, v in held.items() if v < state[t][0]]:
                    del held[other]
    return changed


@pytest.mark.parametrize("alg,params,offer", [
    ("HLLP", {"p": 4, "sp": 9}, offer_hllpp),
    ("CTE", {"tip": 20, "p": 4, "estimator": "HLL"}, offer_cte),
    ("BJKST", {"tries": 2, "set_size": 3, "error": 0.5}, offer_bjkst),
])
def test_novelty_of_sketches_that_change_form(spark, alg, params, offer):
    df = spark.range(1500).selectExpr(
        "id", "CAST(id % 4 = 0 AS INT) AS key", "CAST(pmod(xxhash64(id), 300) AS BIGINT) AS value"
    )
    flagged = novelty_flag(df, ["key"], "value", ["id"], alg, hash="mix", **params)
    rows = flagged.withColumn("h", hash60("value", "mix")).orderBy("id").collect()
    assert {r.id for r in rows if r.is_novel} == replayed(rows, "key", offer)
    assert len(rows) == 1500


@pytest.mark.parametrize("code", sorted(SKETCHES))
def test_every_method_has_a_novelty_rule(spark, code):
    df = spark.range(30).withColumn("value", F.col("id") % 10)
    novel = novelty_flag(df, [], "value", ["id"], code).where("is_novel")
    assert sorted(r.id for r in novel.collect())[0] == 0
