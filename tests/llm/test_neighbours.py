"""The k-means tree against brute force."""

import numpy as np
from pyspark.sql import functions as F

from distinctspark.llm.kmeans_tree import nearest_neighbours

KIND = "vec_id long, embedding array<float>, rank string, leaf string"


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], KIND)


def brute(vectors, k):
    out = {}
    for q, x in vectors:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - x) ** 2).sum())), i) for i, v in vectors if i != q)
            out[q] = [i for _, i in near[:k]]
    return out


def test_recall_and_hot_leaf(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16))
    x[1000:1900] = x[1000]  # one vector holds a large share
    vectors = [(i, np.float32(v).astype(float).tolist()) for i, v in enumerate(x)]
    bad = [(None, [1.0] * 16), (9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16),
           (9004, [1.0, None] * 8), (9005, [float("inf")] * 16), (9006, [1.0, 2.0]), (9007, [])]
    got = nearest_neighbours(rows_of(spark, vectors + bad), F.col("vec_id") % 100 == 0).collect()
    want, found = brute(vectors, 10), {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    assert set(found) == set(want)
    for near in found.values():
        assert sorted(near) == list(range(1, 11)) and [near[i] for i in range(1, 11)] == sorted(near.values())
    hits = sum(len({v for _, v in found[q].values()} & set(want[q])) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert [v for _, v in sorted(found[1100].values())] == list(range(1000, 1010))


def test_few_and_none(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [5.0, 5.0])]
    got = nearest_neighbours(rows_of(spark, few), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert nearest_neighbours(rows_of(spark, few).limit(0), F.col("vec_id") == 0).count() == 0


def test_doubles_are_measured_as_doubles(spark):
    near = [(0, [1.0, 1.0]), (1, [1.0, 1.0 + 1e-10]), (2, [1.0, 1.0 + 3e-10]), (2, [1.0, 1.0 + 2e-10])]
    rows = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    got = nearest_neighbours(rows, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]
    assert abs(got[0].score - 1e-10) < 1e-16 and abs(got[1].score - 2e-10) < 1e-16
