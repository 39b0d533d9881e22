"""Quality grades by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distinctspark.llm.words import Words, list_array, prefix_hashes, word_chunks
from distinctspark.session import materialize

#: Bound of the labelled sample the model is fitted on; scoring covers every document.
TRAIN_ROWS = 20_000
#: A hashed word that only one sampled document holds says nothing about others.
MIN_DOCS = 2
#: Standard errors by which the mean grade of a feature's documents must differ from the sample's
#: for any weight.  Beyond it, a feature learns in proportion to 1 - (EVIDENCE / z)^2, as a shrunken
#: mean does: little evidence gives a little weight, at every size of the sample.
EVIDENCE = 2.0
SHARDS, ROUNDS, EPOCHS, BATCH = 8, 12, 6, 32
RATE, DECAY = 1.0, 1e-6
#: A document is accepted if it has the top grade at least this probably.
ACCEPT = 0.5
GRADES = 3

#: Bytes of the word beginnings that are features beside whole words, for inflected stems.
PREFIXES = (4, 5, 6)
_LEVELS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"!#$%&*+/<=>@\\^_|~")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _shares(words: Words, unique: np.ndarray) -> np.ndarray:
    """Rows of shares in [0, 1]: repeats, capitals, symbols, digits, distinct words, length."""
    n_rows, n = words.last - words.first, np.diff(words.offsets)
    row, at, end = words.row_of(), words.starts, words.ends - 1
    again = np.zeros(len(row), dtype=bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])
    capital = (end > at) & _UPPER[words.data[at]] & _UPPER[words.data[np.minimum(at + 1, end)]]
    symbol, digit = _SYMBOL[words.data[end]], _DIGIT[words.data[end]]
    shares = [np.bincount(row[flag], minlength=n_rows) / np.maximum(n, 1)
              for flag in (again, capital, symbol, digit)]
    shares.append(unique / np.maximum(n, 1))
    shares.append(np.log2(n + 1.0) / 20)
    return np.stack(shares, axis=1)


def features(words: Words) -> list[np.ndarray]:
    """Per row, the sorted distinct feature codes: 32-bit word and prefix hashes, then shapes.

    Shape codes lie above 2^32, one per share and level reached, so levels add up.
    """
    cut, found = words.offsets, []
    hashes = [words.hashes, *(prefix_hashes(words, n) for n in PREFIXES)]
    codes = np.stack(hashes) >> np.uint64(32)
    unique = np.zeros(words.last - words.first)
    for i in range(words.last - words.first):
        own = codes[:, cut[i] : cut[i + 1]]
        unique[i] = len(np.unique(own[0]))
        found.append(np.unique(own))
    shares = _shares(words, unique)
    for i, share in enumerate(shares):
        levels = share[:, None] >= _LEVELS
        kind, level = np.nonzero(levels)
        shape = (kind * len(_LEVELS) + level).astype(np.uint64) + (np.uint64(1) << np.uint64(32))
        found[i] = np.concatenate([found[i], shape])
    return found


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(w.x - cuts[k]); one weight per feature, cuts in order."""

    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, -50.0))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        z = np.clip(scores[:, None] - self.cuts, -60, 60)
        return 1 / (1 + np.exp(-z))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows or len(self.codes) == 0:
            return np.zeros(len(rows))
        flat = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(self.codes, flat), len(self.codes) - 1)
        hit = self.codes[at] == flat
        return np.bincount(row[hit], weights=self.weights[at[hit]], minlength=len(rows))


def _featurise(known: np.ndarray | None) -> Callable:
    """(doc_id, grade, text) rows to (doc_id, grade, codes); with ``known``, to places in it."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in word_chunks(batch.column(2)):
                rows = features(chunk)
                if known is not None:
                    rows = [_places(known, r) for r in rows]
                own = batch.slice(chunk.first, len(rows))
                kind = pa.int64() if known is None else pa.int32()
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), list_array(rows, kind)],
                    ["doc_id", "grade", "codes"])

    return featurise


def _places(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return at[known[at] == codes].astype(np.int32)


def _step(model: Ordinal, scale: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One shard's stochastic gradient epochs from the shared model.

    A feature's value is its ``scale``, so both its score and its gradient are.
    """

    def train(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("order", kind="stable")
        w, cuts = model.weights.copy(), model.cuts.copy()
        rows = [np.asarray(codes, dtype=np.int64) for codes in shard["codes"]]
        grade = shard["grade"].to_numpy()
        rng = np.random.Generator(np.random.PCG64(11))
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), BATCH):
                pick = order[low : low + BATCH]
                flat = np.concatenate([rows[i] for i in pick])
                row = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
                score = np.bincount(row, weights=(w * scale)[flat], minlength=len(pick))
                z = np.clip(score[:, None] - cuts, -60, 60)
                tail = 1 / (1 + np.exp(-z))
                # P(grade) = tail[grade - 1] - tail[grade], with tails 1 and 0 at the ends.
                full = np.hstack([np.ones((len(pick), 1)), tail, np.zeros((len(pick), 1))])
                y, i = grade[pick], np.arange(len(pick))
                p = np.maximum(full[i, y] - full[i, y + 1], 1e-9)
                slope = full * (1 - full)
                up, down = slope[i, y] / p, slope[i, y + 1] / p
                g_score = (down - up) / len(pick)
                gw = np.bincount(flat, weights=g_score[row], minlength=len(w)) * scale + DECAY * w
                gc = np.zeros(len(cuts) + 2)
                np.add.at(gc, y, up / len(pick))
                np.add.at(gc, y + 1, -down / len(pick))
                gc = gc[1:-1]
                w -= RATE * gw
                cuts = np.maximum.accumulate(cuts - RATE * gc)
        return pd.DataFrame({"shard": [int(shard["shard"].iloc[0])], "n": [len(rows)],
                             "weights": [w], "cuts": [cuts]})

    return train


def _steps(model: Ordinal, scale: np.ndarray) -> Callable:
    """:func:`_step` for each shard whose stored rows a task reads; nothing is shuffled."""
    train = _step(model, scale)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if rows:
            for _, shard in pd.concat(rows).groupby("shard"):
                yield train(shard)

    return each


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ordinal:
    """Fit grades quality + (1 - toxic) on a bounded sample of labelled documents.

    The sample is the ``train_rows`` labels of smallest hashed doc_id; only that many ids are
    broadcast.  It is trained in ``SHARDS`` tasks whose models are averaged, ``ROUNDS`` times
    (iterative parameter mixing), so no task holds more than its share of the sample.  Labels
    that are NULL or have no document are ignored; without any, every document is accepted.  Where no
    feature tells grades apart, every document has the sample's share of the top grade.
    """
    order = F.xxhash64("doc_id")
    grade = (F.col("quality") + 1 - F.col("toxic")).cast("int")
    sample = labels.select(F.col("doc_id").cast("long"), grade.alias("grade"), order.alias("order"))
    sample = sample.where(f"doc_id IS NOT NULL AND grade BETWEEN 0 AND {GRADES - 1}")
    sample = materialize(sample.orderBy("order", "doc_id", "grade").limit(train_rows), "sample")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(
        F.broadcast(sample.drop("order")), "doc_id").select("doc_id", "grade", "text")
    table = texts.mapInArrow(_featurise(None), "doc_id long, grade int, codes array<long>")
    mean, spread = texts.agg(F.avg("grade"), F.stddev_pop("grade")).first()
    if mean is None:
        return Ordinal()
    found = []
    if spread:  # with one grade only, nothing tells documents apart
        common = table.select("grade", F.explode("codes").alias("code")).groupBy("code").agg(
            F.count("*").alias("n"), F.sum("grade").alias("sum")).where(F.col("n") >= MIN_DOCS)
        z = F.abs(F.col("sum") - F.col("n") * mean) / (F.sqrt("n") * spread)
        # At most the features of the bounded sample.
        found = common.select("code", z.alias("z")).where(F.col("z") > EVIDENCE).collect()
    codes = np.array([r.code for r in found], dtype=np.int64).view(np.uint64)
    if len(codes) == 0:
        tails = texts.agg(*[F.avg((F.col("grade") > k).cast("int")) for k in range(GRADES - 1)]).first()
        p = np.clip(np.array(tails, dtype=float), 1e-6, 1 - 1e-6)
        return Ordinal(cuts=np.log((1 - p) / p))
    order_of = np.argsort(codes)
    codes = codes[order_of]
    scale = 1 - (EVIDENCE / np.array([r.z for r in found]))[order_of] ** 2
    model = Ordinal(codes, np.zeros(len(codes)), np.linspace(-2.0, 0.0, GRADES - 1))
    table = texts.mapInArrow(_featurise(codes), "doc_id long, grade int, codes array<int>")
    shards = table.withColumn("order", order).withColumn("shard", F.expr(f"pmod(order, {SHARDS})"))
    shards = materialize(shards.repartitionByRange(SHARDS, "shard"), "labelled")
    for _ in range(ROUNDS):
        parts = shards.mapInPandas(
            _steps(model, scale), "shard int, n long, weights array<double>, cuts array<double>")
        parts = sorted(parts.collect(), key=lambda r: (r.shard, r.n))
        share = np.array([p.n for p in parts], dtype=float) / sum(p.n for p in parts)
        model = Ordinal(
            codes,
            sum(s * np.array(p.weights) for s, p in zip(share, parts, strict=True)),
            sum(s * np.array(p.cuts) for s, p in zip(share, parts, strict=True)))
    return Ordinal(codes, model.weights * scale, model.cuts)


def _grader(model: Ordinal, text_at: int, kept: int, accept: float) -> Callable:
    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in word_chunks(batch.column(text_at)):
                tails = model.tails(model.scores(features(chunk)))
                own = batch.slice(chunk.first, len(tails))
                added = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]),
                         pa.array(tails[:, -1] >= accept)]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *added],
                    [*batch.schema.names, "expected_grade", "p_top", "accepted"])

    return grade


def grade(docs: DataFrame, model: Ordinal, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with ``expected_grade`` (0 to 2), ``p_top`` = P(top grade) and ``accepted``.

    Scores whole texts, one row per row of ``docs``; all columns pass through, and columns of
    these three names are replaced.  A NULL or empty text has length features only and is graded
    like any other.
    """
    docs = docs.drop("expected_grade", "p_top", "accepted")
    schema = T.StructType(list(docs.schema)).add("expected_grade", "double")
    schema = schema.add("p_top", "double").add("accepted", "boolean")
    return docs.mapInArrow(
        _grader(model, docs.columns.index("text"), len(docs.columns), accept), schema)
