"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from distinctspark.llm.linededup import drop_repeated_runs
from distinctspark.llm.minhash import near_duplicates
from distinctspark.llm.mixing import mixed_documents
from distinctspark.llm.ordinal import fit, grade
from distinctspark.llm.pieces import encode, load
from distinctspark.session import materialize, new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents it rejects go.

    Documents without text are graded like any other; without labels, all stay.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade(docs, model).where("accepted").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of line runs go, and documents of which nothing else was left.

    A NULL text stays, with NULL for n_chars.
    """
    cut = drop_repeated_runs(docs)
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike("[^ \\t-\\r]")
    cut = cut.where(~empty | F.col("text").isNull())
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup at 0.8: one document of each group stays.

    The default 32 bands of 5 miss a pair at 0.8 with probability 3e-6.  Of rows that repeat a
    doc_id the one with the least text stays; rows without a doc_id are left alone.
    """
    near = near_duplicates(docs, percent=80)
    gone = near.where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    repeated = materialize(repeated.select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    least = kept.join(repeated, "doc_id").groupBy("doc_id").agg(
        F.min(F.struct("text", *others)).alias("row")).select("doc_id", "row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(
        least.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's schedule takes it, cut where it stops.

    Documents without words go; an empty table stays empty.
    """
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: sampled ids in place of the text (none for an empty or NULL one)."""
    return encode(docs, load()).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Hashing, model fitting and sampling have no SQL; the stages are tested one by one instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
