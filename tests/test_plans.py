"""What the plans look like: pruned scans, no Python, no cross joins."""

import re

import pytest
from pyspark.sql import functions as F

from distinctspark import make_sketch, windowed_distinct
from distinctspark.sources.events import limit_duration
from tests.test_sketches import ALL

LINEITEM = "/root/testdata/sf0.001/lineitem.parquet"
EVENTS = "/root/testdata/sf0.001/events.parquet"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("alg", ALL)
def test_one_pass_reads_two_columns_and_stays_in_the_jvm(spark, alg):
    sketch = make_sketch(alg, hash="mix", **ALL[alg])
    rows = spark.read.parquet(LINEITEM)
    keys = ["l_returnflag"]
    plan = plan_of(sketch.lower(sketch.one_pass(rows, keys, "l_orderkey"), keys))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_returnflag", "l_orderkey"}
    assert "IsNotNull(l_orderkey)" in plan
    for bad in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


@pytest.mark.parametrize("alg", ["LL", "AC", "HLL", "HLLP", "LC"])
def test_register_state_combines_before_the_shuffle(spark, alg):
    sketch = make_sketch(alg, **ALL[alg])
    rows = spark.read.parquet(LINEITEM)
    plan = plan_of(sketch.one_pass(rows, ["l_returnflag"], "l_orderkey"))
    assert plan.count("Exchange hashpartitioning") == 1
    before_shuffle = plan.split("Exchange hashpartitioning")[1]
    assert "HashAggregate" in before_shuffle


def test_slices_are_aggregated_before_windows_expand(spark):
    rows = spark.read.parquet(EVENTS)
    plan = plan_of(
        windowed_distinct(rows, ["event_type"], "user_id", "ts", 36_000_000, 1_800_000, p=6)
    )
    expand = plan.index("Expand") if "Expand" in plan else plan.index("Generate")
    assert "HashAggregate" in plan[expand:]
    assert "Exchange hashpartitioning" in plan[expand:]


def test_duration_cut_is_pushed_to_the_scan(spark):
    cut = limit_duration(spark.read.parquet(EVENTS), "ts", F.expr("INTERVAL 1 DAY"))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(ts", plan_of(cut))
