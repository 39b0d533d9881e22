"""The stages of the pipeline one by one, and all of them on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 7))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], KIND)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled documents, a third of them bad, and odd ones."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, words(rng, 60) + (" awful" * 3 if bad else ""), f"s{i % 4}"))
        labels.append((i, int(not bad or i % 2), int(bad)))
    line = words(rng, 60)
    rows += [(1000, f"{words(rng, 30)}\n{line}", "s1"), (1001, f"{line}\n{words(rng, 30)}", "s1"),
             (1002, line, "s2"), (1003, None, "s1"), (1004, "", "s1"), (1005, " \n ", None),
             (1006, words(rng, 40_000), "s0"), (None, words(rng, 30), "s1")]
    near = words(rng, 200)
    rows += [(1010, near, "s3"), (1011, near + " more", "s3"), (1012, near, "s2"), (1012, near, "s2")]
    path = tmp_path_factory.mktemp("pipeline")
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_keep_good(spark, folder):
    kept = {r.doc_id for r in p.keep_good(spark, docs(spark, folder), folder).collect()}
    bad = [i for i in range(0, 300, 3) if i not in kept]
    assert len(bad) >= 95 and len([i for i in range(300) if i % 3 and i in kept]) >= 190
    assert {1003, 1004, None} <= kept


def test_drop_repeated_lines(spark, folder):
    out = {r.doc_id: r for r in p.drop_repeated_lines(spark, docs(spark, folder), folder).collect()}
    assert 1002 not in out and len(out[1001].text.split()) == 30 and len(out[1000].text.split()) == 90
    assert out[1003].text is None and out[1004].text == "" and out[1005].text == " \n "
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text is not None)


def test_drop_near_duplicates(spark, folder):
    found = p.drop_near_duplicates(spark, docs(spark, folder), folder)
    assert found.columns == docs(spark, folder).columns
    kept = sorted(str(r.doc_id) for r in found.collect())
    assert len(kept) == len(set(kept)) and {"1010", "None", "1003", "1004"} <= set(kept)
    assert not {"1011", "1012"} & set(kept)
    twice = frame(spark, [(5, "b b", "x"), (5, "a a", "x"), (5, "a a", "x"), (None, "c", "x"), (None, "c", "x")])
    left = sorted((str(r.doc_id), r.text) for r in p.drop_near_duplicates(spark, twice, folder).collect())
    assert left == [("5", "a a"), ("None", "c"), ("None", "c")]


def test_mix_sources(spark, folder):
    source = docs(spark, folder)
    out = p.mix_sources(spark, source, folder)
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    whole = source.agg(F.sum(size)).first()[0]
    assert abs(sum(got.values()) / whole - 1) < 0.01
    assert out.where("text IS NULL OR n_chars != length(text)").count() == 0


def test_encode_pieces(spark, folder):
    out = p.encode_pieces(spark, docs(spark, folder), folder)
    assert "text" not in out.columns and out.where("doc_id IN (1003, 1004) AND size(ids) > 0").count() == 0
    assert out.where("doc_id = 1006 AND size(ids) > 40000").count() == 1


def test_run_on_odd_rows_and_none(spark, folder, tmp_path):
    out = p.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids"] and out.count() > 150
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
