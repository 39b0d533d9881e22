"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first search."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distinctspark.session import materialize

#: Bound of the sample the tree is fitted on; every row is indexed.
SAMPLE = 20_000
BRANCH, LEAF = 8, 40  # children of a node; sampled vectors below which it is a leaf
#: Calibration: so many queries are answered by brute force over all rows, ...
CALIBRATION = 200
#: ... and leaf visits are widened until this share of their neighbours is found.
TARGET = 0.97
#: Rows of a leaf, and queries, that are compared at once.
BLOCK, QUERIES = 96, 256
#: Found rows that wait in a search task to be joined.
HELD = 1 << 20
ITERATIONS = 12


@dataclass
class Tree:
    """Node i has children first[i] .. first[i] + count[i] - 1; count 0 is a leaf."""

    centres: np.ndarray
    first: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # its number, or -1

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into, descending to the nearest centre."""
        done = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            at, rows = todo.pop()
            if self.count[at] == 0:
                done[rows] = self.leaf[at]
                continue
            children = np.arange(self.first[at], self.first[at] + self.count[at])
            near = _squares(vectors[rows], self.centres[children]).argmin(axis=1)
            todo += [(int(c), rows[near == i]) for i, c in enumerate(children) if (near == i).any()]
        return done

    def best_first(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which a priority queue of nodes, nearest centre first, gives them."""
        queue = [(0.0, 0)]
        while queue:
            _, at = heapq.heappop(queue)
            if self.count[at] == 0:
                yield self.leaf[at]
                continue
            children = range(self.first[at], self.first[at] + self.count[at])
            for c, d in zip(children, _squares(query[None], self.centres[list(children)])[0], strict=True):
                heapq.heappush(queue, (float(d), c))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two small blocks."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's iterations from k-means++ seeds; may give fewer centres than k."""
    centres = rows[[rng.integers(len(rows))]]
    while len(centres) < k:
        near = _squares(rows, centres).min(axis=1)
        if near.sum() <= 0:
            break
        centres = np.vstack([centres, rows[rng.choice(len(rows), p=near / near.sum())]])
    for _ in range(ITERATIONS):
        owner = _squares(rows, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, rows)
        n = np.bincount(owner, minlength=len(centres))
        centres = sums[n > 0] / n[n > 0, None]
    return centres


def fit_tree(sample: np.ndarray, seed: int = 1) -> Tree:
    """Cluster the sample, then each cluster, until LEAF vectors or one distinct vector are left."""
    rng = np.random.Generator(np.random.PCG64(seed))
    tree, todo = Tree(sample.mean(axis=0, keepdims=True), [0], [0], [-1]), [(0, sample)]
    while todo:
        at, rows = todo.pop(0)
        centres = _kmeans(rows, BRANCH, rng) if len(rows) > LEAF else rows[:1]
        if len(centres) < 2:
            tree.leaf[at] = tree.leaves
            continue
        tree.first[at], tree.count[at] = len(tree.first), len(centres)
        owner = _squares(rows, centres).argmin(axis=1)
        tree.centres = np.vstack([tree.centres, centres])
        for i in range(len(centres)):
            todo.append((len(tree.first), rows[owner == i]))
            tree.first.append(0)
            tree.count.append(0)
            tree.leaf.append(-1)
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences in double precision."""
    out = np.empty((len(queries), len(rows)))
    for i, q in enumerate(queries):
        d = rows - q
        out[i] = np.sqrt((d * d).sum(axis=1))
    return out


def _top(query_ids: np.ndarray, ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[list, list, list]:
    """Of each query its k nearest rows but itself; ties go to the smaller id."""
    q_out, v_out, d_out = [], [], []
    for q, row in zip(query_ids, distances, strict=True):
        at = np.flatnonzero(ids != q)
        if len(at) > k:
            limit = np.partition(row[at], k - 1)[k - 1]
            at = at[row[at] <= limit]
        at = at[np.lexsort((ids[at], row[at]))][:k]
        q_out.append(np.full(len(at), q))
        v_out.append(ids[at])
        d_out.append(row[at])
    return q_out, v_out, d_out


def _batch(parts: tuple[list, list, list]) -> pa.RecordBatch:
    columns = [np.concatenate(p) if p else np.zeros(0) for p in parts]
    kinds = (np.int64, np.int64, np.float64)
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(t)) for c, t in zip(columns, kinds, strict=True)],
        ["query_id", "vec_id", "score"])


def _brute(query_ids: np.ndarray, queries: np.ndarray, k: int) -> Callable:
    """Candidates of a fixed, bounded set of queries among the rows of each batch."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            yield _batch(_top(query_ids, ids, _nearest(queries, rows), k))

    return search


def _assigner(tree: Tree) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.assign(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaves.astype(np.int32))], ["vec_id", "v", "leaf"])

    return assign


def _router(tree: Tree, sizes: np.ndarray, visits: int, k: int) -> Callable:
    """(query, leaf) rows: the first ``visits`` leaves, and on until they hold k other rows."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves = [], []
            for i, query in enumerate(_matrix(batch.column(1))):
                held = 0
                for n, leaf in enumerate(tree.best_first(query)):
                    if n >= visits and held > k:
                        break
                    held += int(sizes[leaf])
                    rows.append(i)
                    leaves.append(leaf)
            taken = batch.take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(leaves, type=pa.int32())], ["query_id", "q", "leaf"])

    return route


def _searcher(k: int) -> Callable:
    """(queries, block) rows of one leaf to the nearest of each query.

    A task joins what its blocks give a query before it is shuffled, so a query leaves a task with
    about ``k`` rows, not ``k`` of every block.  At most HELD rows wait in a task.
    """

    def unpack(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        ids, vectors = cell.values.field(0), cell.values.field(1)
        return ids.to_numpy(), _matrix(vectors)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, fresh, n_kept, n_fresh = [], [], 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, queries = unpack(batch.column(0)[i])
                ids, rows = unpack(batch.column(1)[i])
                found = _batch(_top(query_ids, ids, _nearest(queries, rows), k))
                fresh.append(found)
                n_fresh += found.num_rows
                if n_fresh >= max(n_kept, HELD // 8):
                    kept, fresh, n_fresh = [_joined(kept + fresh, k)], [], 0
                    n_kept = kept[0].num_rows
                    if n_kept > HELD // 2:
                        yield from kept
                        kept, n_kept = [], 0
        if kept or fresh:
            yield _joined(kept + fresh, k)

    return search


def _joined(parts: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """The ``k`` nearest different rows of each query among these."""
    query, vec, score = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(3))
    order = np.lexsort((score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    if len(query):
        new = np.append(True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1]))
        query, vec, score = query[new], vec[new], score[new]
        order = np.lexsort((vec, score, query))
        query, vec, score = query[order], vec[order], score[order]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        sizes = np.diff(np.append(starts, len(query)))
        near = np.arange(len(query)) - np.repeat(starts, sizes) < k
        query, vec, score = query[near], vec[near], score[near]
    return pa.RecordBatch.from_arrays(
        [pa.array(query), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, target: float = TARGET
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of every query row.

    ``vectors`` has vec_id and embedding; ``is_query`` picks the query rows.  The tree is fitted on
    at most SAMPLE rows (those of smallest hashed id) and every row is put into the leaf it falls
    into.  A query visits leaves best bin first.  How many: CALIBRATION queries are answered by
    brute force, and visits are widened until ``target`` of their neighbours lie in visited leaves;
    a query goes on until the leaves hold k rows.  Leaves are compared in blocks of about BLOCK
    rows, so a leaf of very many equal vectors is many blocks.

    Distances are Euclidean on the original vectors; ties go to the smaller vec_id.  Rows whose
    vec_id or vector is NULL, whose vector is empty, zero or holds NULL or non-finite components, or
    has another dimension than most, take no part.  Rows of one vec_id are one result, at their least
    distance, and a query whose id repeats asks with each of its vectors.  Other
    columns are ignored; an empty table gives no rows.
    """
    # As precise as they come: doubles stay doubles.
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast(vector).alias("v"), is_query.alias("ask"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    spread = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    common = spread.orderBy(F.desc("n"), "dim").first()
    kind = "query_id long, vec_id long, score double"
    if common is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                           F.lit(0.0).alias("score")).limit(0)
    rows = rows.where(F.size("v") == common.dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    tree = fit_tree(np.array([r.v for r in sample], dtype=np.float64))
    index = materialize(
        rows.select("vec_id", "v").mapInArrow(_assigner(tree), f"vec_id long, v {vector}, leaf int"),
        "index")
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    counts = index.groupBy("leaf").agg(F.count("*").alias("n"))
    for row in counts.collect():  # one row per leaf, of which the sample's bound allows few
        sizes[row.leaf] = row.n

    queries = rows.where("ask").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    visits = _calibrate(tree, index, queries, k, target)
    routed = queries.mapInArrow(
        _router(tree, sizes, visits, k), f"query_id long, q {vector}, leaf int")
    chunks = routed.groupBy("leaf", F.expr(f"pmod(xxhash64(query_id), greatest(1, {_shares(queries)}))")
                            .alias("part")).agg(
        F.collect_list(F.struct("query_id", "q")).alias("queries")).drop("part")
    parts = counts.select("leaf", F.ceil(F.col("n") / BLOCK).alias("parts"))
    blocks = index.join(F.broadcast(parts), "leaf").groupBy(
        "leaf", F.expr("pmod(xxhash64(vec_id), parts)").alias("part")).agg(
        F.collect_list(F.struct("vec_id", "v")).alias("block")).drop("part")
    found = chunks.join(blocks, "leaf").select("queries", "block").mapInArrow(_searcher(k), kind)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _shares(queries: DataFrame) -> int:
    """Parts that keep the queries of one leaf within QUERIES, even if all of them visit it."""
    return -(-queries.count() // QUERIES)


def _calibrate(tree: Tree, index: DataFrame, queries: DataFrame, k: int, target: float) -> int:
    """The number of leaf visits that finds ``target`` of the true neighbours of some queries."""
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).collect()
    if tree.leaves == 1 or not asked:
        return 1
    ids = np.array([r.query_id for r in asked], dtype=np.int64)
    vectors = np.array([r.q for r in asked], dtype=np.float64)
    near = index.select("vec_id", "v").mapInArrow(
        _brute(ids, vectors, k), "query_id long, vec_id long, score double")
    truth = _ranked(near, k).join(index.select("vec_id", "leaf").dropDuplicates(["vec_id"]), "vec_id")
    place = {q: {leaf: n for n, leaf in enumerate(tree.best_first(v))}
             for q, v in zip(ids.tolist(), vectors, strict=True)}
    needed = sorted(place[r.query_id][r.leaf] + 1 for r in truth.collect())  # k per query
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 1
