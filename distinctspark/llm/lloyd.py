"""Product codes of vectors by Lloyd's rounds over members that stay where they are.

A vector is cut into parts; each part position has a codebook of its own.  The members (a part and
its row) live in tables partitioned by (position, entry, salt).  A round reads the members where they
lie: those whose nearest entry is still their owner's are only summed, and just those that change go
through a shuffle to their new owner, which adds up what arrives.  Nothing is rewritten: a member of
an earlier table is resident as long as every codebook since its arrival leaves it there, which the
codebooks themselves tell.  So a round writes its movers only, and a lost task reads stored tables.

The codebooks (entries x dimensions whole numbers) are all that the driver and the tasks share.

Rows without a vector, or with a NULL or non-finite component, take no part; nor do vectors of
another length than the commonest (ties: the shorter).  A length that the parts do not divide is
padded with zeros.  Repeated rows are members each; of vectors that share one of the smallest
vec_ids, the least one seeds; a NULL vec_id is the largest.  With fewer seeds than entries, the
codebooks are that much smaller.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distinctspark.llm.words import list_array
from distinctspark.session import equi_join, join_group_params, materialize, new_path

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components become whole numbers of this scale.
SCALE = 4096
#: A (position, entry) has so many salts that an owner holds about this many members at most ...
MEMBERS = 8192
#: ... and never fewer than this, so that a small table spreads as well.
LEAST_SALTS = 64

#: A member (n NULL; its part as 32-bit numbers), or what an owner has summed (row NULL).
_MEMBER = "row long, position int, entry int, salt int, gen int, part binary, n long, sums array<long>"
_ARROW = pa.schema([
    ("row", pa.int64()), ("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()),
    ("gen", pa.int32()), ("part", pa.binary()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
])

#: One codebook per part position: entries x width.
Codebooks = list[np.ndarray]


@dataclass(frozen=True)
class Compressed:
    """``codes``: vec_id, label, code (two hex digits a part), error; and the last codebooks."""

    codes: DataFrame
    codebooks: Codebooks

    @property
    def sha256(self) -> str:
        numbers = ",".join(str(int(v)) for book in self.codebooks for v in book.reshape(-1))
        return hashlib.sha256(numbers.encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, in exact whole numbers."""
    small = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < 1 << 20 and book.shape[1] <= 1 << 11
    kind = np.float64 if small else np.int64  # sums of products of small ones stay below 2^53
    x, book = x.astype(kind), book.astype(kind)
    scores = (book * book).sum(1) - 2 * (x @ book.T)
    entry = scores.argmin(1)  # the first of equals
    distance = np.take_along_axis(scores, entry[:, None], 1)[:, 0] + (x * x).sum(1)
    return entry, distance.astype(np.int64)


class Sums:
    """Counts and sums of parts by (position, entry, salt)."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, int, int], list] = {}

    def add(self, owners: np.ndarray, n: np.ndarray, parts: np.ndarray) -> None:
        if not len(owners):
            return
        order = np.lexsort(owners.T)
        owners, n, parts = owners[order], n[order], parts[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, (owners[1:] != owners[:-1]).any(1)])
        for key, count, total in zip(owners[first].tolist(), np.add.reduceat(n, first).tolist(),
                                     np.add.reduceat(parts, first), strict=True):
            known = self.of.setdefault(tuple(key), [0, 0])
            known[0] += count
            known[1] = known[1] + total

    def batch(self) -> pa.RecordBatch:
        keys = np.array(list(self.of), dtype=np.int32).reshape(-1, 3)
        none = [None] * len(keys)
        sums = list_array([v[1] for v in self.of.values()])
        columns = [none, keys[:, 0], keys[:, 1], keys[:, 2], none, none, [v[0] for v in self.of.values()], sums]
        return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c
                                           for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _parts(batch: pa.RecordBatch) -> np.ndarray:
    """members x width, of a batch without sums."""
    column = batch.column(_ARROW.names.index("part"))
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = memoryview(data)[ends[0] : ends[-1]] if data else b""
    return np.frombuffer(body, np.int32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int32)


def _members(row, position, entry, salt, gen, part) -> pa.RecordBatch:
    n = len(row)
    ends = np.arange(n + 1, dtype=np.int32) * 4 * part.shape[1]
    body = np.ascontiguousarray(part, np.int32)
    parts = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(body)])
    ints = [pa.array(c.astype(np.int32)) for c in (position, entry, salt, np.broadcast_to(gen, n))]
    none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(row), *ints, parts, *none], schema=_ARROW)


def _settle(books: Codebooks, salts: int):
    """Vectors -> their parts, at the owners the first codebooks give."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)
            width, salt = books[0].shape[1], row % salts
            vectors = np.pad(vectors, ((0, 0), (0, width * len(books) - vectors.shape[1])))
            for position, book in enumerate(books):
                part = vectors[:, position * width : (position + 1) * width]
                entry, _ = nearest(part, book)
                yield _members(row, np.full(len(row), position), entry, salt, 1, part)

    return step


def _residents(batch: pa.RecordBatch, rounds: list[Codebooks]) -> tuple[np.ndarray, ...]:
    """Of a batch of members: those still resident, their new entries and distances, their parts.

    ``rounds`` are the codebooks of rounds 1, 2, ... up to the present one.
    """
    position, entry, gen = (batch.column(_ARROW.names.index(c)).to_numpy() for c in ("position", "entry", "gen"))
    part = _parts(batch)
    resident, new, distance = np.ones(len(entry), bool), entry.copy(), np.zeros(len(entry), np.int64)
    for p in np.unique(position):
        for known in range(2, len(rounds) + 1):
            at = np.flatnonzero((position == p) & resident & (gen < known))
            found, far = nearest(part[at], rounds[known - 1][p])
            if known < len(rounds):
                resident[at[found != entry[at]]] = False
            else:
                new[at], distance[at] = found, far
    at = np.flatnonzero(resident)
    return at, new[at], distance[at], part[at]


def _move(rounds: list[Codebooks]):
    """Members -> those that change entry; and the sums of those that stay."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay = Sums()
        for batch in batches:
            at, new, _, part = _residents(batch, rounds)
            row, position, entry, salt = (batch.column(c).to_numpy()[at] for c in range(4))
            same = new == entry
            stay.add(np.stack([position, entry, salt], 1)[same], np.ones(same.sum(), np.int64), part[same])
            go = ~same
            yield _members(row[go], position[go], new[go], salt[go], len(rounds), part[go])
        yield stay.batch()

    return step


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At the owners: members pass, and each owner's sums over what stayed and what came follow."""
    held = Sums()
    for batch in batches:
        summed = batch.column(6).is_valid().to_numpy(zero_copy_only=False)
        members, sums = batch.filter(pa.array(~summed)), batch.filter(pa.array(summed))
        for own, n, parts in ((members, np.ones(members.num_rows, np.int64), _parts),
                              (sums, sums.column(6).to_numpy(), lambda own: _matrix(own.column(7), own.num_rows))):
            if own.num_rows:
                held.add(np.stack([own.column(c).to_numpy() for c in (1, 2, 3)], 1), n, parts(own))
        yield members
    yield held.batch()


def _codes(rounds: list[Codebooks]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, new, distance, _ = _residents(batch, rounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_numpy()[at]), pa.array(batch.column(1).to_numpy()[at]),
                 pa.array(new.astype(np.int32)), pa.array(distance)],
                names=["row", "position", "entry", "distance"])

    return step


def _updated(books: Codebooks, owned: DataFrame) -> Codebooks:
    """Entries replaced by the floored mean of their members; unused ones stay."""
    width = books[0].shape[1]
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    found = owned.where("n IS NOT NULL").groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums).collect()
    out = [book.copy() for book in books]
    for r in found:
        out[r.position][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def quantised(vectors: DataFrame, width_parts: int) -> DataFrame:
    """row, vec_id, label, q (whole numbers) of the rows that take part, stored."""
    dims = F.size("embedding")
    inf = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & sound)
    # Beyond this a squared error would not fit a long.
    limit = F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(dims, F.lit(width_parts))))

    def whole(x):
        return F.greatest(F.least(F.floor(x.cast("double") * SCALE), limit), -limit).cast("int")

    kept = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", dims.alias("dims"),
                       F.transform("embedding", whole).alias("q"))
    stored = materialize(kept, "quantised")
    common = stored.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    return stored.where(F.col("dims") == (common.dims if common else 0))


def _seeds(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    ids = rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries)
    least = equi_join(rows.select("vec_id", "q"), F.broadcast(ids), ["vec_id"], "inner")
    least = least.groupBy("vec_id").agg(F.min("q").alias("q")).orderBy(F.asc_nulls_last("vec_id"))
    book = np.array([r.q for r in least.collect()], dtype=np.int64)  # at most ``entries`` vectors
    if not len(book):
        return [np.zeros((0, 0), np.int64)] * parts
    width = max(1, math.ceil(book.shape[1] / parts))
    book = np.pad(book, ((0, 0), (0, width * parts - book.shape[1])))
    return [book[:, p * width : (p + 1) * width] for p in range(parts)]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codes of ``vectors`` (vec_id, label, embedding) and the codebooks they refer to."""
    if not (1 <= parts <= 8 and 1 <= entries <= 256 and rounds >= 1):
        raise ValueError("a code has at most 8 parts of two hex digits, and there is a round at least")
    spark, rows = vectors.sparkSession, quantised(vectors, parts)
    books = [_seeds(rows, parts, entries)]
    n = rows.count()
    if not n:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Compressed(empty, books[0])
    salts = max(LEAST_SALTS, -(-n // MEMBERS))
    tables: list[str] = []

    def residents() -> DataFrame:
        return spark.read.schema(_MEMBER).parquet(*tables).where("n IS NULL")

    for present in range(1, rounds + 1):
        if present == 1:
            moved = rows.select("row", "q").mapInArrow(_settle(books[0], salts), _MEMBER)
        else:
            moved = residents().mapInArrow(_move(books), _MEMBER)
        owned = moved.repartition("position", "entry", "salt").mapInArrow(_own, _MEMBER)
        path = new_path(spark, "members")
        owned.write.parquet(path)
        tables.append(path)
        books.append(_updated(books[-1], spark.read.schema(_MEMBER).parquet(path)))
    coded = residents().mapInArrow(_codes(books), "row long, position int, entry int, distance long")
    bits = F.call_function("shiftleft", F.col("entry").cast("long"), F.lit(8 * parts - 8) - F.col("position") * 8)
    null = {c: F.lit(None).cast(t) for c, t in rows.select("vec_id", "label").dtypes}
    coded = coded.select("row", bits.alias("bits"), "distance", *[v.alias(c) for c, v in null.items()])
    named = rows.select("row", F.lit(None).cast("long").alias("bits"), F.lit(None).cast("long").alias("distance"),
                        "vec_id", "label")
    whole = coded.unionByName(named).groupBy("row").agg(
        F.bit_or("bits").alias("bits"), F.sum("distance").alias("error"),
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"),
    )
    code = F.lower(F.substring(F.lpad(F.hex("bits"), 16, "0"), 17 - 2 * parts, 2 * parts))
    codes = materialize(whole.select("vec_id", "label", code.alias("code"), "error"), "codes")
    return Compressed(codes, books[-1])


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels (NULLs together)."""
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_group_params(codes, totals, ["label"], weight="n")
