"""Language identification: held-out accuracy, odd rows, the network's arithmetic."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from distinctspark.llm import langid
from distinctspark.llm.langid import LENGTH, Network, Scorer, fit, predict, training_windows

KIND = "doc_id long, text string, lang string, source string, score string, held_out int"
SYLLABLES = {
    "aa": "ka ti mo re su na".split(),
    "bb": "sch ung eit ver ich ach".split(),
    "cc": "été aux eau oir que ion".split(),
}


def text_of(lang, rng, n):
    words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize()


def made(spark, rows):
    return spark.createDataFrame([(*r, "s", "x", 3) for r in rows], KIND)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    names = ["aa"] * 6 + ["bb"] * 2 + ["cc"]
    return [(i, text_of(names[i % 9], rng, int(rng.integers(3, 200))), names[i % 9]) for i in range(500)]


@pytest.fixture(scope="module")
def model(spark, rows):
    return fit(made(spark, rows), 3000)


def test_held_out_accuracy(spark, rows, model):
    got = {r.doc_id: r for r in predict(made(spark, rows), model).collect()}
    assert len(got) == len(rows) and model.languages == ["aa", "bb", "cc"]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    right = sum(got[i].lang_pred == lang for i, _, lang in held)
    assert len(held) > 60 and right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = predict(docs, fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_odd_rows(spark, model):
    rng = np.random.default_rng(6)
    long = text_of("bb", rng, 100_000)
    odd = [(1, None, "aa"), (2, "", "aa"), (3, "12 34 !?", "bb"), (None, text_of("aa", rng, 40), None),
           (5, long, None), (6, "é", "cc"), (7, text_of("aa", rng, 40), "x"), (7, text_of("aa", rng, 40), "x")]
    got = predict(made(spark, odd), model).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert by[None].lang_pred == "aa" and by[None].held_out
    assert by[5].lang_pred == "bb" and by[6].lang_pred in model.languages
    assert [r.lang_pred for r in got if r.doc_id == 7] == ["aa", "aa"]


def test_nothing_one_language_and_repeats_to_learn_from(spark, rows):
    none = made(spark, [(1, "abc", None), (2, None, "aa")])
    model = fit(none)
    assert model.languages == [] and {r.lang_pred for r in predict(none, model).collect()} == {"und"}
    empty = made(spark, rows).limit(0)
    assert predict(empty, fit(empty)).count() == 0
    one = made(spark, [(i, "abc def", "zz") for i in range(9)])
    assert {(r.lang_pred, r.score) for r in predict(one, fit(one)).collect()} == {("zz", 1.0)}
    hot = made(spark, [(1, "word " * 100, "aa")] * 900 + [(i, f"text {i}", "aa") for i in range(2, 30)])
    assert training_windows(hot, 400).groupBy("key", "start").count().where("count > 1").count() == 0


def test_bound_and_held_out_rows_are_not_learned_from(spark, rows):
    docs = made(spark, rows)
    sample = training_windows(docs, 60)
    assert 0 < sample.count() <= 60
    changed = made(spark, [(i, t if zlib.crc32(str(i).encode()) % 5 else "other words", lang) for i, t, lang in rows])
    assert sorted(map(tuple, training_windows(changed, 60).collect())) == sorted(map(tuple, sample.collect()))
    assert sorted(map(tuple, training_windows(docs.repartition(13), 60).collect())) == sorted(map(tuple, sample.collect()))


def test_scorer_equals_plain_convolution():
    net = Network.fresh(3)
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (5, LENGTH), dtype=np.uint8)
    peaks = []
    for table in net.tables:
        w = len(table)
        at = np.stack([sum(table[j][windows[:, t + j]] for j in range(w)) for t in range(LENGTH - w + 1)])
        peaks.append(at.max(0))
    raw = np.maximum(np.concatenate(peaks, 1), 0) @ net.layer
    want = np.exp(raw - raw.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    assert np.allclose(Scorer(net).scores(windows), want, atol=1e-5)


def test_every_byte_lies_in_a_window():
    class Count:
        def scores(self, windows):
            seen.append(windows.copy())
            return np.ones((len(windows), 2))

    for sizes in ([1, 2, 3], [LENGTH], [LENGTH + 1], [langid.STRIDE * 3 + 3, 0, 5], [1000, 4]):
        seen = []
        data = np.full(sum(sizes), 97, np.uint8)
        langid._text_scores(Count(), data, np.cumsum([0, *sizes]), 2)
        held = sum(int((w == 97).sum()) for w in seen)
        n = sum(len(w) for w in seen)
        full = sum(s for s in sizes)
        assert held == full + (LENGTH - langid.STRIDE) * (n - sum(s > 0 for s in sizes))
