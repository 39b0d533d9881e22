"""Language of a text by a byte convolutional network, trained here in numpy.

Texts are cut into windows of ``LENGTH`` bytes that overlap by one filter width, so every n-gram of a
text lies whole in a window.  A window's score is: filters of several widths over its bytes, the
maximum of each filter along the window, one linear layer, softmax.  A one-hot byte times a filter is
a table row, so a convolution is a sum of looked-up rows.

Training is local SGD: shards of the sampled windows are each passed once from the same weights, in
Spark tasks, and the weights averaged, for some rounds.  The sample is bounded: at most WINDOWS
windows, dealt equally to the languages; which documents are in it depends on hashes of the rows
alone, not on partitions.  Prediction reads every window of every text.

``und`` with score 0 for a text that is NULL, empty or without a letter, and for every text where no
labelled row is left to learn from.  Rows that repeat a doc_id are predicted each.  A NULL doc_id has
no remainder; its row is not learned from and counts as held out.  Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distinctspark.llm.words import text_bytes
from distinctspark.session import equi_join, materialize

#: Bound of the training sample, in windows over all languages together.
WINDOWS = 24_000
#: Windows taken of one sampled document at most.
PER_DOC = 4
LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
STRIDE = LENGTH - max(WIDTHS) + 1
SHARDS, ROUNDS, BATCH = 8, 8, 64
RATE = 0.004
HELD_OUT = 5
UNKNOWN = "und"
#: Windows scored at a time.
TILE = 96

#: Bytes as the network sees them: letters small, digits alike, white space and controls alike.
_CODE = np.arange(256, dtype=np.uint8)
_CODE[65:91] += 32
_CODE[48:58] = 48
_CODE[:33] = 32
#: What follows the end of a text.
_PAD = np.uint8(0)


@dataclass
class Network:
    """Filter tables by width (width x 256 x FILTERS), their biases, and the linear layer."""

    tables: list[np.ndarray]
    bias: np.ndarray
    layer: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, n_classes: int) -> Network:
        rng = np.random.Generator(np.random.PCG64(7))
        tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(tables, np.zeros(n, np.float32), rng.normal(0, 0.2, (n, n_classes)).astype(np.float32),
                   np.zeros(n_classes, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.layer, self.offset]

    def packed(self) -> bytes:
        return b"".join(a.tobytes() for a in self.arrays())

    def unpacked(self, data: bytes) -> Network:
        """A network of the same shape from packed weights."""
        flat, out, at = np.frombuffer(data, np.float32), [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).copy())
            at += a.size
        n = len(self.tables)
        return Network(out[:n], *out[n:])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _train_pass(net: Network, windows: np.ndarray, labels: np.ndarray, seed: int) -> Network:
    """One pass over a shard in batches, by Adam."""
    weights = net.arrays()
    first, second = ([np.zeros_like(a) for a in weights] for _ in range(2))
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(labels))
    cells = np.arange(FILTERS)
    for step, begin in enumerate(range(0, len(order), BATCH), 1):
        x, y = windows[order[begin : begin + BATCH]], labels[order[begin : begin + BATCH]]
        peaks, places = [], []
        for w, table in zip(WIDTHS, net.tables, strict=True):
            act = sum(table[j][x[:, j : LENGTH - w + 1 + j]] for j in range(w))
            places.append(act.argmax(1))
            peaks.append(act.max(1))
        raw = np.concatenate(peaks, 1) + net.bias
        top = np.maximum(raw, 0)
        wrong = _softmax(top @ net.layer + net.offset)
        wrong[np.arange(len(y)), y] -= 1
        wrong /= len(y)
        back = (wrong @ net.layer.T) * (raw > 0)
        slopes = []
        for k, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            slope = np.empty((w, 256, FILTERS), np.float32)
            for j in range(w):
                code = np.take_along_axis(x, place + j, 1).astype(np.int64) * FILTERS + cells
                slope[j] = np.bincount(code.ravel(), own.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            slopes.append(slope)
        slopes += [back.sum(0), top.T @ wrong, wrong.sum(0)]
        for a, m, v, g in zip(weights, first, second, slopes, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _passes(net: Network, round_: int):
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "start", "cls"], kind="stable")
        windows = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, LENGTH)
        shard = int(rows["shard"].iloc[0])
        done = _train_pass(net.unpacked(net.packed()), windows, rows["cls"].to_numpy(), 1000 * round_ + shard)
        return pd.DataFrame({"shard": [shard], "n": [len(rows)], "net": [done.packed()]})

    return train


@dataclass
class Model:
    languages: list[str]
    net: Network | None


def _window_of(data: np.ndarray, start: int) -> np.ndarray:
    out = np.full(LENGTH, _PAD, np.uint8)
    own = data[start : start + LENGTH]
    out[: len(own)] = _CODE[own]
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, lang, text -> up to PER_DOC training windows of each text, at places its key draws."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        keys, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for i, key in enumerate(keys):
            own = data[offsets[i] : offsets[i + 1]]
            starts = range(0, len(own), STRIDE)
            if len(starts) > PER_DOC:
                drawn = np.random.Generator(np.random.PCG64(key & (2**63 - 1))).permutation(len(starts))
                starts = [int(s) * STRIDE for s in sorted(drawn[:PER_DOC])]
            out += [(key, langs[i], start, _window_of(own, start).tobytes()) for start in starts]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                         names=["key", "lang", "start", "window"])


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def training_windows(docs: DataFrame, bound: int = WINDOWS) -> DataFrame:
    """At most ``bound`` (key, lang, start, window) rows of learnable documents.

    Each language gets an equal share of documents: a hash threshold first, which needs only the
    languages' counts, then the exact share of the few that pass.
    """
    known = docs.where((remainder() != 0) & F.col("lang").isNotNull() & has_letter())
    counts = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    n_languages = max(1, counts.count())
    share = max(1, bound // (n_languages * PER_DOC))
    wanted = counts.select("lang", (F.lit(2.0 * share) / F.col("n")).alias("rate"))
    if n_languages <= bound:
        wanted = F.broadcast(wanted)  # at most ``bound`` rows
    key = F.xxhash64("doc_id", "text", "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = equi_join(known.select("doc_id", "lang", "text"), wanted, ["lang"], "inner").where(draw < F.col("rate"))
    # Equal rows count once, so a repeated row cannot fill the sample.
    once = drawn.groupBy(key.alias("key"), "lang").agg(F.first("text").alias("text"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    chosen = ranked.where(F.col("rank") <= share).select("key", "lang", "text")
    return materialize(chosen.mapInArrow(_cut, "key long, lang string, start int, window binary"), "windows")


def fit(docs: DataFrame, bound: int = WINDOWS) -> Model:
    """A network for the languages of ``docs`` (doc_id, text, lang)."""
    sample = training_windows(docs.select("doc_id", "text", "lang"), bound)
    languages = sorted((r.lang for r in sample.select("lang").distinct().collect()), key=str.encode)
    if not languages:
        return Model([], None)
    net = Network.fresh(len(languages))
    if len(languages) == 1:
        return Model(languages, net)
    names = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    shard = F.pmod(F.xxhash64("key", "start"), F.lit(SHARDS)).cast("int")
    rows = materialize(sample.select("key", "start", "window", names[F.col("lang")].alias("cls"),
                                     shard.alias("shard")), "shards")
    for round_ in range(ROUNDS):
        passed = rows.groupBy("shard").applyInPandas(_passes(net, round_), "shard int, n long, net binary")
        found = sorted(passed.collect(), key=lambda r: r.shard)  # SHARDS rows
        total = sum(r.n for r in found)
        mean = sum(np.frombuffer(r.net, np.float32).astype(np.float64) * (r.n / total) for r in found)
        net = net.unpacked(mean.astype(np.float32).tobytes())
    return Model(languages, net)


class Scorer:
    """Class probabilities of windows, with pairs of bytes looked up at once."""

    def __init__(self, net: Network) -> None:
        self.net = net
        # A filter of width w is pairs (0, 1), (2, 3), ... and a single byte where w is odd.
        self.pairs = [
            [(t[j][:, None] + t[j + 1][None]).reshape(-1, FILTERS) for j in range(0, len(t) - 1, 2)]
            for t in net.tables
        ]
        self.sums = np.empty((TILE * LENGTH, FILTERS), np.float32)
        self.more = np.empty_like(self.sums)

    def scores(self, windows: np.ndarray) -> np.ndarray:
        n = len(windows)
        pair = (windows[:, :-1].astype(np.intp) << 8) | windows[:, 1:]
        peaks = []
        for table, pairs in zip(self.net.tables, self.pairs, strict=True):
            w = len(table)
            span = LENGTH - w + 1
            lookups = [(own, pair[:, 2 * k : 2 * k + span]) for k, own in enumerate(pairs)]
            if w % 2:
                lookups.append((table[w - 1], windows[:, w - 1 : w - 1 + span].astype(np.intp)))
            act = self.sums[: n * span]
            np.take(lookups[0][0], lookups[0][1].ravel(), axis=0, out=act, mode="clip")
            for own, at in lookups[1:]:
                more = self.more[: n * span]
                np.take(own, at.ravel(), axis=0, out=more, mode="clip")
                act += more
            act = act.reshape(n, span, FILTERS)
            while act.shape[1] > 1:  # halves against each other: long runs of memory
                half = act.shape[1] // 2
                top = np.maximum(act[:, :half], act[:, half : 2 * half])
                if act.shape[1] % 2:
                    np.maximum(top[:, 0], act[:, -1], out=top[:, 0])
                act = top
            peaks.append(act[:, 0])
        top = np.maximum(np.concatenate(peaks, 1) + self.net.bias, 0)
        return _softmax(top @ self.net.layer + self.net.offset)


def _text_scores(scorer: Scorer, data: np.ndarray, offsets: np.ndarray, n_classes: int) -> np.ndarray:
    """Mean class probabilities of each text over its windows, by the bytes they hold."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - (LENGTH - STRIDE)) // STRIDE)) * (sizes > 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][text] + nth * STRIDE
    held = np.minimum(LENGTH, offsets[1:][text] - start)
    totals = np.zeros((len(sizes), n_classes))
    inner, end = np.arange(LENGTH), len(data) - 1
    for begin in range(0, len(text), TILE):
        own = slice(begin, begin + TILE)
        windows = _CODE[data[np.minimum(start[own, None] + inner, end)]]
        windows[inner >= held[own, None]] = _PAD
        scores = scorer.scores(windows) * held[own, None]
        np.add.at(totals, text[own], scores)
    return totals / np.maximum(totals.sum(1, keepdims=True), 1e-300)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    languages, net = model.languages, model.net
    kind = docs.schema["doc_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            names, best = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if scorer and letters.any():
                data, offsets = text_bytes(batch.column(1))
                scores = _text_scores(scorer, data, offsets, len(languages))
                top = scores.argmax(1)
                names[letters] = np.array(languages, object)[top[letters]]
                best[letters] = np.round(np.minimum(scores.max(1), 1.0), 6)[letters]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(names, pa.string()), pa.array(best)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder() == 0, F.lit(True))
    rows = docs.select("doc_id", "text", has_letter().alias("letter"), held.alias("held_out"))
    return rows.mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

