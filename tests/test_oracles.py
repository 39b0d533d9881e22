"""Every registered query with an SQL form, against DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, db, name):
    got = queries()[name](spark, FOLDER)
    want = db.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_native_queries_are_close(spark, db, name):
    """Built-in sketches use their own hashes, so only their error is checked."""
    rows = queries()[name](spark, FOLDER).collect()
    assert rows
    exact = dict(db.sql("SELECT l_returnflag, count(DISTINCT l_orderkey) FROM lineitem "
                        "GROUP BY 1").fetchall())  # fmt: skip
    for r in rows:
        if "estimate" in r.asDict():
            assert abs(r.estimate / exact[r.l_returnflag] - 1) < 0.1
        if "union_estimate" in r.asDict():
            assert abs(r.union_estimate / exact[r.l_returnflag] - 1) < 0.1


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["window_start", "window_end", "event_type", "estimate"]
    assert df.count() > 0
