"""The queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from distinctspark.llm import langid
from distinctspark.llm.chaining import fuzzy_passages
from distinctspark.llm.html import extract_text
from distinctspark.llm.kmeans_tree import nearest_neighbours
from distinctspark.llm.linededup import drop_repeated_runs
from distinctspark.llm.lloyd import compress, with_label_error
from distinctspark.llm.merkle import document_manifest
from distinctspark.llm.minhash import near_duplicates
from distinctspark.llm.mixing import mix
from distinctspark.llm.ordinal import fit, grade
from distinctspark.llm.pieces import decode, encode, load
from distinctspark.llm.pii import personal_data
from distinctspark.llm.syncmers import fingerprints

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha256(text: str) -> Column:
    """Lowercase hex digest of a text column; NULL counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = drop_repeated_runs(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"),
                      sha256("text").alias("text_sha256"))


@query
def op2_kmeans_tree_ann(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_closed_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


@query
def op4_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


@query
def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    graded = grade(docs, fit(docs, table(spark, folder, "labels")))
    return graded.select("doc_id", "expected_grade", "p_top", "accepted")


@query
def op7_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    pages = extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_fuzzy_passages(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy_passages(table(spark, folder, "documents"))


@query
def op9_sentencepiece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    pieces = load()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = decode(encode(docs, pieces), pieces)
    lossless = F.coalesce("text", F.lit("")) == F.coalesce("decoded", F.lit(""))
    return coded.select("doc_id", "ids", F.size("ids").alias("n_pieces"), lossless.alias("lossless"),
                        sha256("decoded").alias("decoded_sha256"))


@query
def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return document_manifest(table(spark, folder, "documents"))


@query
def op12_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.fit(docs))


@query
def op13_resident_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    found = compress(table(spark, folder, "embeddings"))
    books = F.lit(found.sha256).alias("codebooks_sha256")
    return with_label_error(found.codes).select("vec_id", "code", "error", "label_error", books)
