"""Repeated runs of lines: a suffix array over line sequences, sorted by prefix doubling."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distinctspark.operators.ordered import running_total
from distinctspark.session import materialize

#: A run counts as repeated from so many lines on, or so many words in fewer lines.
MIN_LINES, MIN_WORDS = 3, 50
#: Above any number of lines of a run.
_RUN = 64
_LAST = (1 << 63) - 1
_BLANK = " \t\n\x0b\f\r"


def _keys() -> list:
    """What names a document: its id (NULL last) and its text's hash, for ids that repeat."""
    return [F.coalesce("doc_id", F.lit(_LAST)).alias("_d"), F.xxhash64("text").alias("_t")]


def line_positions(docs: DataFrame) -> DataFrame:
    """(_d, _t, i, l1, l2, w): hash (128 bits) and words of line ``i`` of each text, blank ones left out."""
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    return docs.select(*_keys(), F.posexplode(lines).alias("i", "line")).select(
        "_d", "_t", "i", F.xxhash64("line").alias("l1"),
        F.xxhash64(F.lit(1), "line").alias("l2"),
        F.regexp_count("line", F.lit("[^ \\t-\\r]+")).alias("w"))


def sorted_suffixes(lines: DataFrame, depth: int) -> list[tuple[int, DataFrame]]:
    """(depth, (_d, _t, i, r, w)): suffix arrays of the line sequences, by 1, 2, 4, ... ``depth`` lines.

    ``r`` is the number of kept suffixes that are smaller, so equal ranks are an interval of
    longest common prefix >= the depth; ``w`` is the number of words of that prefix, but at the last
    depth.  Lines are ranked first; then every step sorts by the pair (rank here, rank ``step`` lines
    on), which doubles the sorted depth.  A suffix that is alone with its prefix can be in no
    interval and leaves the array, as does one that ends too early.  Lines are ordered by hash: any
    order of lines gives the same intervals.
    """
    counted = lines.groupBy(F.struct("l1", "l2").alias("line")).agg(F.count("*").alias("c"))
    ranked = running_total(counted.where("c > 1"), [], "line", "c")
    ranked = ranked.select("line.*", (F.col("running") - F.col("c")).alias("r"))
    array = lines.join(ranked, ["l1", "l2"]).select("_d", "_t", "i", "r", "w")
    # Rows that repeat a document in full are that document, not copies of it.
    array, sorted_to = materialize(array.distinct(), "suffixes"), 1
    steps = [(sorted_to, array)]
    while sorted_to < depth:
        step = min(sorted_to, depth - sorted_to)
        later = array.select("_d", "_t", (F.col("i") - step).alias("i"), F.col("r").alias("s"),
                             F.col("w").alias("more"))
        # Only the last step may overlap, and words do not matter there.
        pairs = array.join(later, ["_d", "_t", "i"]).withColumn("w", F.col("w") + F.col("more"))
        pairs = materialize(pairs.drop("more"), "pairs")
        groups = pairs.groupBy("r", "s").agg(F.count("*").alias("c"))
        # Within a rank, the pairs before it: the sort that splits the rank.
        ranks = running_total(groups, ["r"], "s", "c").where("c > 1").select(
            "r", "s", (F.col("r") + F.col("running") - F.col("c")).alias("rank"))
        array = pairs.join(ranks, ["r", "s"]).select("_d", "_t", "i", F.col("rank").alias("r"), "w")
        array, sorted_to = materialize(array, "suffixes"), sorted_to + step
        steps.append((sorted_to, array))
    return steps


def later_copies(arrays: list[tuple[int, DataFrame]], min_words: int) -> DataFrame:
    """(_d, _t, _runs): start * _RUN + lines of the runs of a document that stand earlier elsewhere.

    Of each interval the smallest position (document, then line) is the original.  All intervals of
    the last depth count, those before it from ``min_words`` words on.
    """
    at, found = F.struct("_d", "_t", "i"), []
    for depth, array in arrays:
        if depth < arrays[-1][0]:
            array = array.where(F.col("w") >= min_words)
        first = array.groupBy("r").agg(F.min(at).alias("first"), F.count("*").alias("n"))
        # Written, so that the join deals both sides out anew and Spark may split a common run.
        first = materialize(first.where("n > 1"), "originals")
        copies = array.join(first, "r").where(at != F.col("first"))
        found.append(copies.select("_d", "_t", (F.col("i") * _RUN + depth).alias("run")))
    every = functools.reduce(DataFrame.unionByName, found)
    return every.groupBy("_d", "_t").agg(F.collect_set("run").alias("_runs"))


def _cutter(text_at: int, runs_at: int, kept: int) -> Callable:
    def cut(text: str | None, runs: list[int] | None) -> tuple[str, int, int]:
        if not text:
            return text, 0, 0
        lines = text.split("\n")
        if not runs:
            return text, len(lines), 0
        gone = {run // _RUN + j for run in runs for j in range(run % _RUN)}
        out, i = [], 0
        for line in lines:
            content = bool(line.strip(_BLANK))
            if not (content and i in gone):
                out.append(line)
            i += content
        return "\n".join(out), len(lines), len(gone)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(text_at), batch.column(runs_at)
            rows = [cut(a.as_py(), b.as_py()) for a, b in zip(texts, runs, strict=True)]
            columns = batch.columns[:kept]
            columns[text_at] = pa.array([r[0] for r in rows], type=pa.string())
            counts = [pa.array([r[k] for r in rows], type=pa.int64()) for k in (1, 2)]
            names = [*batch.schema.names[:kept], "n_lines", "n_removed"]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names)

    return apply


def drop_repeated_runs(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with the later copies of repeated line runs cut out of ``text``.

    Lines are parts between newlines; blank ones are passed over in matching and never removed.
    A run of at least ``min_lines`` lines, or of 1, 2, 4, ... fewer lines with at least ``min_words``
    words, that also stands at an earlier position (smaller doc_id, or earlier in the same document)
    is a later copy; every line covered by one is removed, so the earliest copy of each maximal run
    stays whole.  Copies may overlap.

    Adds ``n_lines`` and ``n_removed``, replacing columns of these names.  A NULL text stays NULL
    with no lines; a NULL doc_id counts as the largest.  Rows equal in doc_id and text are one
    document and get one result.  All other columns pass through; an empty table stays empty.
    The names ``_d``, ``_t`` and ``_runs`` are kept for the operator.
    """
    if not 1 <= min_lines < _RUN:
        raise ValueError(f"min_lines must be in [1, {_RUN})")
    docs = docs.drop("n_lines", "n_removed")
    lines = materialize(line_positions(docs), "lines")
    runs = later_copies(sorted_suffixes(lines, min_lines), min_words)
    joined = docs.select("*", *_keys()).join(runs, ["_d", "_t"], "left")
    joined = joined.select(*docs.columns, "_runs")
    schema = T.StructType(list(docs.schema)).add("n_lines", "long").add("n_removed", "long")
    names = docs.columns
    return joined.mapInArrow(_cutter(names.index("text"), len(names), len(names)), schema)
