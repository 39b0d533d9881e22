"""Near-duplicate documents: MinHash, banding, exact confirmation, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distinctspark.llm.components import components
from distinctspark.llm.words import list_array, mix, shingle_sets, word_chunks
from distinctspark.session import materialize

#: 32 bands of 5 minima: a pair at 0.85 shares no band with probability 7e-9.
BANDS, ROWS = 32, 5
SHINGLE = 5
#: Standard errors below the threshold at which a signature still passes.
SLACK = 5.0
#: Star rounds with a changing leader before the exhaustive one.
STAR_ROUNDS = 2


class Hashes:
    """``n`` universal functions x -> (a x + b) >> 32 over 64-bit shingles."""

    def __init__(self, n: int, seed: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima per non-empty set."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.empty((len(sets), len(self.a)), dtype=np.uint32)
        work = np.empty_like(flat)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.multiply(flat, a, out=work)
            work += b
            out[:, i] = np.minimum.reduceat(work, starts) >> np.uint64(32)
        return out


def _band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(minima), bands), dtype=np.uint64)
    parts = minima.reshape(len(minima), bands, rows).astype(np.uint64)
    for j in range(rows):
        keys = mix(keys + parts[:, :, j] + np.uint64(1))
    return mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signed(values: list) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _signer(k: int, bands: int, rows: int, seed: int) -> Callable:
    hashes = Hashes(bands * rows, seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in word_chunks(batch.column(1)):
                sets = shingle_sets(chunk, k)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [np.zeros(0, np.uint64)] * len(sets)
                if some:
                    found = _band_keys(hashes.minima([sets[i] for i in some]), bands, rows)
                    for i, row in zip(some, found, strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, len(sets)),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        _signed([mix(s).sum() for s in sets]),
                        _signed([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() for s in sets]),
                        list_array(keys),
                    ],
                    ["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return sign


def _featurer(k: int, n: int, seed: int) -> Callable:
    hashes = Hashes(n, seed)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in word_chunks(batch.column(1)):
                sets = shingle_sets(chunk, k)
                some = [i for i, s in enumerate(sets) if len(s)]
                if some:
                    minima = hashes.minima([sets[i] for i in some])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(chunk.first, len(sets)).take(pa.array(some)),
                            pa.array([row.tobytes() for row in minima], type=pa.binary()),
                            list_array([sets[i] for i in some]),
                        ],
                        ["doc_id", "minima", "shingles"],
                    )

    return features


def _confirmer(percent: int, n: int) -> Callable:
    near = percent / 100
    floor = n * (near - SLACK * np.sqrt(near * (1 - near) / n))

    def values(column: pa.Array, row: int) -> np.ndarray:
        low, high = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
        return column.values[low:high].to_numpy(zero_copy_only=False).view(np.uint64)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, mine, other, ours, theirs = batch.columns
            kept = []
            for i in range(batch.num_rows):
                a = np.frombuffer(mine[i].as_py(), dtype=np.uint32)
                b = np.frombuffer(other[i].as_py(), dtype=np.uint32)
                if np.count_nonzero(a == b) < floor:
                    continue
                x, y = values(ours, i), values(theirs, i)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            take = pa.array(kept, type=pa.int64())
            yield pa.RecordBatch.from_arrays([u.take(take), v.take(take)], ["u", "v"])

    return confirm


def _confirm(pairs: DataFrame, features: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough.

    The first join brings the leader's set to rows of two ids only, so a leader of thousands is
    a hot key of tiny rows; the second is by member.
    """
    v = features.select(F.col("doc_id").alias("v"), F.col("minima").alias("minima_v"),
                        F.col("shingles").alias("shingles_v"))
    u = features.select(F.col("doc_id").alias("u"), "minima", "shingles")
    rows = pairs.join(v, "v").join(u, "u")
    rows = rows.select("u", "v", "minima", "minima_v", "shingles", "shingles_v")
    return rows.mapInArrow(_confirmer(percent, n), "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    k: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, ...).

    Documents are linked when their sets of distinct ``k``-word shingles (A-Z lower-cased, whole
    texts) have 100 * intersection >= percent * union; a component is named by its smallest
    doc_id, whose document is kept.

    Documents of equal sets form a class, and only its smallest doc_id goes on.  Class members
    that share a band are candidates.  Within a bucket, members are compared with a leader; the
    leader changes from round to round, and members already connected to it are left out.  What
    is still apart after the star rounds is joined by an exact prefix filter, across components
    only, so no link between components is lost and a large group of copies costs stars.  Candidates pass a
    signature test ``SLACK`` standard errors below the threshold, then the exact test.

    A NULL or blank text has no shingles and no links.  Rows with a NULL doc_id are returned with
    a NULL component and kept.  Repeated doc_ids are one document.  Other columns are ignored;
    an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialize(
        texts.mapInArrow(
            _signer(k, bands, rows, seed),
            "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>",
        ),
        "signed",
    )
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        full.groupBy("s1", "s2", "n_shingles").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("members"),
            F.first("bands").alias("bands")),
        "classes",
    )
    copies = (
        full.select("doc_id", "s1", "s2", "n_shingles")
        .join(classes.where("members > 1").drop("bands"), ["s1", "s2", "n_shingles"])
        .where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    links = materialize(copies.distinct(), "copies")

    held = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    # Group tables are written before they are joined back: the join then deals both sides out
    # anew, and Spark may split a hot key.
    shared = held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared.select("key"), "shared")
    buckets = materialize(held.join(shared, "key"), "buckets")
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    features = materialize(
        texts.join(wanted, "doc_id").select("doc_id", "text").mapInArrow(
            _featurer(k, bands * rows, seed),
            "doc_id long, minima binary, shingles array<long>"),
        "features",
    )
    labels, checked = components(links), None
    for step in range(STAR_ROUNDS + 1):
        named = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep"))
        order = F.xxhash64("rep", "key", F.lit(step)) if step else F.col("rep")
        lead = F.min_by(F.struct("rep", "component", "n_shingles"), order).alias("lead")
        apart = named.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), lead
        ).where("low != high")
        apart = materialize(apart, "leaders")
        if step < STAR_ROUNDS:
            found = named.join(apart, "key").where("component != lead.component").select(
                F.col("rep").alias("a"), F.col("lead.rep").alias("b"),
                F.col("n_shingles").alias("na"), F.col("lead.n_shingles").alias("nb"))
        else:
            still = named.join(apart.select("key"), "key").select("rep", "component").distinct()
            found = _across(still, features, percent)
        found = found.where(
            F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
        found = found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        if checked is not None:
            found = found.join(checked, ["u", "v"], "left_anti")
        found = materialize(found, "pairs")
        if found.isEmpty():
            continue
        confirmed = materialize(_confirm(found, features, percent, bands * rows), "links")
        checked = found if checked is None else checked.unionByName(found)
        if confirmed.isEmpty():
            continue
        links = links.unionByName(confirmed)
        labels = components(links)
    result = signed.select("doc_id", "n_shingles").join(
        labels.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")),
        "doc_id", "left")
    result = result.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return result.withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))


def _across(apart: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of ``apart`` (rep, component, n_shingles) that may still be linked.

    A prefix filter with positions, exact for the threshold: shingles are ordered from rare to
    common, and of a linked pair the first shared one stands early in both sets.  Where many
    copies differ from a common text by shingles of their own, those come first, so the common
    shingles stand too late to make pairs.  Only pairs of different components come out.
    """
    sets = features.dropDuplicates(["doc_id"]).join(
        apart.withColumnRenamed("rep", "doc_id"), "doc_id").select(
        "doc_id", "component", F.size("shingles").alias("n"), "shingles")
    sets = materialize(sets, "apart")
    shingles = sets.select("doc_id", F.explode("shingles").alias("s"))
    shared = shingles.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = materialize(shared, "shared")
    ranked = shingles.join(shared, "s").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))
    ranked = ranked.join(sets.drop("shingles"), "doc_id")
    rows = ranked.select(
        "doc_id", "component", "n", F.size("order").alias("m"), F.posexplode("order").alias("k", "o"))
    # ``rest`` shingles from this one on are all that a pair which meets here first can share;
    # those the document holds alone stand before its shared ones.
    rows = rows.select("doc_id", "component", "n", F.col("o.s").alias("s"),
                       (F.col("m") - F.col("k")).alias("rest"))
    needs = f"{100 + percent} * rest >= {percent} * (n + "
    early = rows.where(f"{needs} n * {percent / 100})")
    least = early.groupBy("s").agg(F.min("n").alias("least"), F.count("*").alias("c"))
    least = materialize(least.where("c > 1"), "least")
    early = materialize(
        early.join(least, "s").where(f"{needs} least)").drop("least", "c"), "early")
    a = early.withColumnsRenamed({"doc_id": "a", "component": "ca", "n": "na", "rest": "ra"})
    b = early.withColumnsRenamed({"doc_id": "b", "component": "cb", "n": "nb", "rest": "rb"})
    enough = (100 + percent) * F.least("ra", "rb") >= percent * (F.col("na") + F.col("nb"))
    return a.join(b, "s").where((F.col("ca") < F.col("cb")) & enough).select("a", "b", "na", "nb")
