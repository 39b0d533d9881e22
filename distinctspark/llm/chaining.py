"""Fuzzy repeated passages: shared seeds, collinear chains, alignment."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distinctspark.llm.grams import Part, frequent_runs
from distinctspark.llm.words import list_array, window_hashes, word_chunks
from distinctspark.session import discard, materialize

#: A seed is a run of K words, the least by hash of W neighbouring ones: every shared run of
#: K + W - 1 words shares a seed.
K, W = 8, 12
#: Cost of a word between two anchors of a chain, in words matched; a wider gap ends a passage.
GAP_COST, MAX_GAP = 0.25, 25
MIN_WORDS, IDENTITY = 50, 0.8
#: Words of a chain that is worth an alignment: two seeds that overlap, or more.
LEAST_CHAIN = 10
#: Words around a chain in which its ends are sought, so one seed may stand for a whole passage.
MARGIN = 40
#: An end is moved outwards as long as its score (1 a match, less EDIT_COST a word inserted, deleted or
#: replaced) stays within DROP of the best so far; alignments drift by BAND words at most.
EDIT_COST, DROP, BAND = 1.5, 8.0, 3
#: An end is tried only if so many of the next LOOK words are common.
LOOK, LEAST_COMMON = 10, 3
#: Passages of one document that are cut out of its text together.
REQUESTS = 64
#: What seeds and chains leave is sought by all runs of Q words.  MIN_WORDS words hold GRAMS of them, and
#: an edit (a word inserted, deleted or replaced) breaks Q at most, so after EDITS edits COMMON are left.
Q, EDITS = 3, round((1 - IDENTITY) * MIN_WORDS)
GRAMS = MIN_WORDS - Q + 1
COMMON = GRAMS - Q * EDITS
#: Words of a window that no passage reported so far may hold: the others hold fewer than COMMON runs.
FREE = MIN_WORDS - (COMMON + Q - 2)
#: Clusters of seeds for one task to align, of which most are too unlike for it.
CLUSTERS = 4000
#: All clusters at once, with their words, may fill the disk: a pass takes one for so many runs that were kept.
RUNS_A_CLUSTER = 40
#: So are the spans cut, in parts of the documents and of their sources: one for so many runs, or SPANS; and the pairs of
#: runs grouped, or SLICE_ROWS.  Joins of runs are cut into SLICES at most.
RUNS_A_SPAN, SPANS = 32, 1 << 16
RUNS_A_PAIR, SLICES, SLICE_ROWS = 4, 4, 1 << 20
#: Columns of an alignment whose every part is tried at once.
COLUMNS = 512
#: Cells of a matrix in which several pairs of texts are aligned together.
CELLS = 1 << 17
#: Words of a and of b, and the least and largest diagonal (place in b less place in a) of a band.
Pair = tuple[np.ndarray, np.ndarray, int, int]


#: Spark then removes the shuffled files of a job at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back; what was shuffled for it is not needed again and goes at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        return materialize(df, label)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)


def _minimizers(hashes: np.ndarray) -> np.ndarray:
    """Indices of the seeds of one document's windows."""
    if len(hashes) <= W:
        return np.array([int(np.argmin(hashes))]) if len(hashes) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, W)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for chunk in word_chunks(batch.column(1)):
            hashes, at = window_hashes(chunk, K)
            cut = np.searchsorted(at, chunk.offsets)
            found, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(chunk.last - chunk.first):
                picked = _minimizers(hashes[cut[i] : cut[i + 1]]) + cut[i]
                found.append(picked)
                rows.append(np.full(len(picked), i))
            found, rows = np.concatenate(found), np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[found].view(np.int64)),
                    pa.array(ids[chunk.first + rows].astype(np.int64)),
                    pa.array((at[found] - chunk.offsets[rows]).astype(np.int32)),
                ],
                ["h", "doc", "pos"],
            )


class Fenwick:
    """Running maxima over ranks 0 .. n - 1, with the index that holds each."""

    def __init__(self, n: int) -> None:
        self.best = [(float("-inf"), -1)] * (n + 1)

    def add(self, rank: int, value: float, index: int) -> None:
        rank += 1
        while rank < len(self.best):
            self.best[rank] = max(self.best[rank], (value, index))
            rank += rank & -rank

    def upto(self, rank: int) -> tuple[float, int]:
        """The largest of ranks 0 to ``rank`` - 1."""
        found = (float("-inf"), -1)
        while rank > 0:
            found = max(found, self.best[rank])
            rank -= rank & -rank
        return found


def merge_anchors(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Seeds (x, y) that touch or overlap on a diagonal, as (x, y, length)."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.r_[True, (np.diff(x - y) != 0) | (np.diff(x) > K)]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(x)] - 1
    return sorted(zip(x[heads].tolist(), y[heads].tolist(), (x[tails] + K - x[heads]).tolist(), strict=True))


def chains(anchors: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of anchors in order in both texts, the heaviest first.

    score(j) = length(j) + max(0, score(i) - GAP_COST * (words between i and j in both texts))
    over the anchors i that end before j in both.  With ends ex, ey and starts sx, sy the gap is
    (sx + sy) - (ex + ey), so the best i has the largest score + GAP_COST * (ex + ey): a prefix
    maximum over ey, kept in a Fenwick tree as the anchors are swept by sx.
    """
    if len(anchors) == 1:
        return [anchors]
    ends = sorted({y + n for _, y, n in anchors})
    rank = {e: i for i, e in enumerate(ends)}
    tree, scores, before = Fenwick(len(ends)), [0.0] * len(anchors), [-1] * len(anchors)
    by_end, done = sorted(range(len(anchors)), key=lambda i: anchors[i][0] + anchors[i][2]), 0
    starts = np.searchsorted(ends, [y for _, y, _ in anchors], "right")
    for j, (x, y, n) in enumerate(anchors):
        while done < len(by_end):
            i = by_end[done]
            ex, ey = anchors[i][0] + anchors[i][2], anchors[i][1] + anchors[i][2]
            if ex > x:
                break
            tree.add(rank[ey], scores[i] + GAP_COST * (ex + ey), i)
            done += 1
        value, i = tree.upto(int(starts[j]))
        scores[j] = float(n)
        if i >= 0 and (gain := value - GAP_COST * (x + y)) > 0:
            scores[j], before[j] = n + gain, i
    used, found = [False] * len(anchors), []
    for j in sorted(range(len(anchors)), key=lambda j: (-scores[j], j)):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(anchors[j])
            j = before[j]
        if chain:
            found.append(chain[::-1])
    return found


def passages(anchors: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The chains, cut at gaps of more than MAX_GAP words."""
    for chain in chains(anchors):
        part = [chain[0]]
        for one in chain[1:]:
            x, y, n = part[-1]
            if max(one[0] - x - n, one[1] - y - n) > MAX_GAP:
                yield part
                part = []
            part.append(one)
        yield part


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, src, anchors) rows to one row per chain that is more than a common phrase."""
    for batch in batches:
        out: list[tuple] = []
        flat, ends = batch.column(2).flatten(), np.cumsum(batch.column(2).value_lengths().to_numpy())
        x, y = (np.split(flat.field(k).to_numpy().astype(np.int64), ends[:-1]) for k in (0, 1))
        for doc, src, *at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), x, y, strict=False):
            for part in passages(merge_anchors(*at)):
                (x, y, _), (ex, ey, n) = part[0], part[-1]
                if max(ex + n - x, ey + n - y) >= LEAST_CHAIN:
                    flat = [v for anchor in part for v in anchor]
                    out.append((doc, src, max(0, x - MARGIN), ex + n + MARGIN,
                                max(0, y - MARGIN), ey + n + MARGIN, flat))
        names = ["doc", "src", "lo", "hi", "slo", "shi", "anchors"]
        kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, spans) rows to (doc, lo, hi, words): 32-bit hashes of the words of each span."""
    for batch in batches:
        spans, first = batch.column(2), 0
        for chunk in word_chunks(batch.column(1)):
            codes = (chunk.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            docs, low, high, words = [], [], [], []
            for i in range(chunk.last - chunk.first):
                own = codes[chunk.offsets[i] : chunk.offsets[i + 1]]
                for span in spans[first + i].as_py():
                    docs.append(first + i)
                    low.append(span["lo"])
                    high.append(span["hi"])
                    words.append(own[span["lo"] : span["hi"]])
            first += chunk.last - chunk.first
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs, type=pa.int64())), pa.array(low, type=pa.int32()),
                 pa.array(high, type=pa.int32()), list_array(words, pa.int32())],
                ["doc", "lo", "hi", "words"])


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short word sequences."""
    if len(a) == 0 or len(b) == 0:
        return 0
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for word in a:
        step = np.maximum(row[1:], row[:-1] + (b == word))
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(words of a, of b, matched) by which an end at the start of both is best moved on."""
    left, right = a.tolist(), b.tolist()
    if len(set(left[:LOOK]) & set(right[:LOOK])) < LEAST_COMMON:
        return 0, 0, 0
    best, found = 0.0, (0, 0, 0)
    # For the words of b used, from ``low`` on: the score, and the words matched.
    low, scores = 0, [-EDIT_COST * j for j in range(min(len(right), BAND) + 1)]
    matches = [0] * len(scores)
    for i, word in enumerate(left, 1):
        first, last = max(0, i - BAND), min(len(right), i + BAND)
        new, counts, floor, alive = [], [], best - DROP, False
        for j in range(first, last + 1):
            k, score, n = j - low, floor - 1, 0
            if 0 < k <= len(scores):
                same = word == right[j - 1]
                score, n = scores[k - 1] + (1 if same else -EDIT_COST), matches[k - 1] + same
            if k < len(scores) and scores[k] - EDIT_COST > score:
                score, n = scores[k] - EDIT_COST, matches[k]
            if new and new[-1] - EDIT_COST > score:
                score, n = new[-1] - EDIT_COST, counts[-1]
            new.append(score)
            counts.append(n)
            if score > best:
                best, found = score, (i, j, n)
            alive = alive or score >= floor
        if not alive:
            break
        low, scores, matches = first, new, counts
    return found


def align(
    a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int, int]], x0: int, y0: int
) -> tuple[int, int, int, int, int]:
    """(start, end, source start, source end, matched words) of a chain in its two word spans.

    Anchors are matched as they are, words between them by longest common subsequence, and the
    ends are moved outwards while words agree, then over edits as :func:`extend` finds best.
    """
    (x, y, _), (ex, ey, n) = anchors[0], anchors[-1]
    x, y, ex, ey = x - x0, y - y0, ex + n - x0, ey + n - y0
    left = min(x, y)
    same = np.flatnonzero(a[x - left : x][::-1] != b[y - left : y][::-1])
    left = int(same[0]) if len(same) else left
    right = max(0, min(len(a) - ex, len(b) - ey))
    same = np.flatnonzero(a[ex : ex + right] != b[ey : ey + right])
    right = int(same[0]) if len(same) else right
    matched = left + right + sum(length for _, _, length in anchors)
    for (ax, ay, length), (bx, by, _) in zip(anchors[:-1], anchors[1:], strict=True):
        matched += common_words(a[ax + length - x0 : bx - x0], b[ay + length - y0 : by - y0])
    x, y, ex, ey = x - left, y - left, ex + right, ey + right
    back = extend(a[:x][::-1], b[:y][::-1])
    on = extend(a[ex:], b[ey:])
    return x0 + x - back[0], x0 + ex + on[0], y0 + y - back[1], y0 + ey + on[1], matched + back[2] + on[2]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "source_doc_id", "start", "end", "source_start", "source_end", "matched"]
    for batch in batches:
        doc, src, lo, slo = (batch.column(i).to_pylist() for i in (0, 1, 2, 3))
        out = []
        for i in range(batch.num_rows):
            flat = batch.column(4)[i].as_py()
            anchors = list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
            a, b = (batch.column(j)[i].values.to_numpy() for j in (5, 6))
            start, end, source, stop, matched = align(a, b, anchors, lo[i], slo[i])
            long = max(end - start, stop - source)
            if long >= MIN_WORDS and matched >= IDENTITY * long:
                out.append((doc[i], src[i], start, end, source, stop, matched))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, at, spans) rows to (h, doc, pos, open): windows of MIN_WORDS words that may occur twice.

    Those in one of the ``spans`` are not ``open``: what they equal is not asked.  ``at`` holds the places of the seeds that occur twice.  A window that occurs twice has only
    such seeds, so the others are left out without loss.
    """
    inner = MIN_WORDS - K - W + 2
    for batch in batches:
        ids, shared, first = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2), 0
        for chunk in word_chunks(batch.column(1)):
            seeds, at = window_hashes(chunk, K)
            whole, starts = window_hashes(chunk, MIN_WORDS)
            cut, low = np.searchsorted(at, chunk.offsets), np.searchsorted(starts, chunk.offsets)
            found, rows, asked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, dtype=bool)]
            for i in range(chunk.last - chunk.first):
                n = low[i + 1] - low[i]
                if n == 0:
                    continue
                view = np.lib.stride_tricks.sliding_window_view(seeds[cut[i] : cut[i + 1]], W)
                known = np.zeros(cut[i + 1] - cut[i], dtype=bool)
                known[shared[first + i].values.to_numpy()] = True
                good = np.r_[0, np.cumsum(known[view.argmin(axis=1) + np.arange(len(view))])]
                picked = np.flatnonzero(good[inner:] - good[:-inner] == inner)
                found.append(picked + low[i])
                rows.append(np.full(len(picked), i))
                spans = batch.column(3)[first + i].values
                start, end = ((np.zeros(0, np.int64),) * 2 if spans is None
                              else (spans.field(k).to_numpy() for k in range(2)))
                asked.append(uncovered(picked, start, end))
            found, rows = np.concatenate(found), np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole[found].view(np.int64)), pa.array(ids[first + rows].astype(np.int64)),
                 pa.array((starts[found] - chunk.offsets[rows]).astype(np.int32)), pa.array(np.concatenate(asked))],
                ["h", "doc", "pos", "open"])
            first += chunk.last - chunk.first


def uncovered(pos: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the windows of MIN_WORDS words at ``pos`` lie in no span ``start`` to ``end``."""
    order = np.argsort(start, kind="stable")
    reach = np.r_[-1, np.maximum.accumulate(end[order])]
    return reach[np.searchsorted(start[order], pos, "right")] < pos + MIN_WORDS


def runs(pos: np.ndarray, src: np.ndarray, spos: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, source, source start) of the windows at ``pos`` that equal those at ``spos`` of ``src``.

    They are joined where they follow each other.
    """
    order = np.lexsort((pos, pos - spos, src))
    pos, src, spos = pos[order], src[order], spos[order]
    new = np.r_[True, (np.diff(src) != 0) | (np.diff(pos - spos) != 0) | (np.diff(pos) != 1)]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(pos)] - 1
    return list(zip(pos[heads].tolist(), (pos[tails] + MIN_WORDS).tolist(), src[heads].tolist(),
                    spos[heads].tolist(), strict=True))


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "source_doc_id", "start", "end", "source_start", "source_end", "matched"]
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            windows, doc = batch.column(1)[i].values, batch.column(0)[i].as_py()
            pos, src, spos = (windows.field(k).to_numpy().astype(np.int64) for k in range(3))
            for low, high, source, at in runs(pos, src, spos):
                out.append((doc, source, low, high, at, at + high - low, high - low))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names)


def _exact_passages(texts: DataFrame, held: DataFrame, reported: DataFrame) -> DataFrame:
    """Passages for the runs of MIN_WORDS equal words that no single reported passage holds.

    Seeds of one run may be dealt to several documents; a whole window is dealt to one, the
    earliest that has it.  ``held`` are the seeds that occur twice, not needed again.
    """
    at = held.groupBy("doc").agg(F.collect_set("pos").alias("at"))
    spans = reported.groupBy(F.col("doc_id").alias("doc")).agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    windows = texts.join(at.join(spans, "doc", "left"), "doc").select("doc", "text", "at", "spans")
    windows = written(windows.mapInArrow(_windows, "h long, doc long, pos int, open boolean"), "windows")
    # Written, as the seeds' originals are.
    first = windows.groupBy("h").agg(
        F.count("*").alias("n"), F.max("open").alias("open"), F.min(F.struct("doc", "pos")).alias("first"))
    first = written(first.where("n > 1 AND open").select("h", "first"), "window_originals")
    discard(held)
    copies = windows.where("open").join(first, "h").where("doc != first.doc OR pos != first.pos")
    copies = copies.groupBy("doc").agg(F.collect_set(F.struct(
        "pos", F.col("first.doc").alias("src"), F.col("first.pos").alias("spos"))).alias("windows"))
    found = written(copies.mapInArrow(_uncovered, reported.schema), "exact_passages")
    discard(windows, first)
    return found


def _widest(values: np.ndarray) -> np.ndarray:
    """For every place, the largest value of the windows of GRAMS places that hold it."""
    none = np.zeros(GRAMS - 1, dtype=values.dtype)
    out, span = np.r_[none, values, none], 1
    while span < GRAMS:
        step = min(span, GRAMS - span)
        out, span = np.maximum(out[:-step], out[step:]), span + step
    return out


def rare_grams(
    pos: np.ndarray, h: np.ndarray, n: np.ndarray, start: np.ndarray, end: np.ndarray, exact: np.ndarray,
    room: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of Q words, at ascending ``pos``, two near passages may have to be found by; and which here.

    Of a window's runs COMMON stand in its near copy too.  So in any order that holds everywhere, here
    by frequency ``n``, the two share one that is not among the last COMMON - 1 of either.  The second
    array has those of windows of which FREE words lie outside the spans ``start`` to ``end``.  Windows
    within an ``exact`` span are passed over: the same words stand at an earlier place.

    ``room`` are the words, MIN_WORDS at least, of documents that follow each other; one if not given.
    """
    if room is None:
        room = np.array([max(int(pos[-1]) + 1, GRAMS) + Q - 1])
    size, begin = int(room.sum()), np.cumsum(room) - room
    keys = (np.minimum(n, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (h.view(np.uint64) >> np.uint64(24))
    dense = np.zeros(size - Q + 1, dtype=np.uint64)
    dense[pos] = keys
    doc = np.searchsorted(begin, pos, "right")
    for i in np.flatnonzero((h[1:] == h[:-1]) & (np.diff(pos) > 1) & (np.diff(doc) == 0)):  # a word repeated
        inside = dense[pos[i] + 1 : pos[i + 1]]
        inside[inside == 0] = keys[i]
    view = np.lib.stride_tricks.sliding_window_view(dense, GRAMS)

    def held(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which windows' first words lie in a range."""
        edge = np.zeros(size + 1, dtype=np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, np.maximum(low, high), -1)
        return np.cumsum(edge)[: len(view)] > 0

    sought = held(begin, begin + room - MIN_WORDS + 1) & ~held(start[exact], end[exact] - MIN_WORDS + 1)
    known = np.r_[0, np.cumsum(dense > 0)]
    least = np.zeros(len(view), dtype=np.uint64)
    enough = np.flatnonzero(sought & (known[GRAMS:] - known[:-GRAMS] >= COMMON))
    for low in range(0, len(enough), 1 << 14):
        some = enough[low : low + (1 << 14)]
        least[some] = np.partition(view[some], GRAMS - COMMON, axis=1)[:, GRAMS - COMMON]
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(start, size), 1)
    np.add.at(edge, np.minimum(end, size), -1)
    free = np.r_[0, np.cumsum(np.cumsum(edge)[:-1] == 0)]
    open_ = free[MIN_WORDS:] - free[:-MIN_WORDS] >= FREE
    return keys <= _widest(least)[pos], keys <= _widest(np.where(open_, least, np.uint64(0)))[pos]


def _select(part: Part, spans: pa.Table) -> pa.Table:
    """(h, doc, pos, own, before) rows: the runs of a part by which near passages are found.

    ``own`` are those of words no span holds.  ``before`` is the run one word earlier, where that is
    among them: two places that share it too are found by it.
    """
    doc, start, end, exact = (spans.column(c).to_numpy() for c in ("doc", "start", "end", "exact"))
    which, start, end = part.spans(doc, start, end)
    h, pos, none = part.h, part.at, np.zeros(0, dtype=bool)
    kept, own = rare_grams(pos, h, part.n, start, end, exact[which].astype(bool), part.room) if len(h) else (none, none)
    follows = np.r_[False, (np.diff(pos) == 1) & kept[:-1] & (own[:-1] | ~own[1:])][: len(h)]
    before = pa.array(np.r_[0, h][:-1][kept], mask=~follows[kept], type=pa.int64())
    return pa.table({"h": h[kept], "doc": part.docs[part.row[kept]], "pos": part.word[kept].astype(np.int32),
                     "own": own[kept], "before": before})


def clusters(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of seeds (x, y) of one group that one near passage may hold: near in x and in diagonal, by single links."""
    for _ in range(2):
        for value, gap in ((x - y, EDITS), (x, 2 * MIN_WORDS)):
            order = np.lexsort((value, group))
            new = (np.diff(group[order]) != 0) | (np.diff(value[order]) > gap)
            group = group.copy()
            group[order] = np.r_[0, np.cumsum(new)][: len(order)]
    return group


def _cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, src, seeds) rows to one row per cluster: word spans, least and largest diagonal."""
    names = ["doc", "src", "lo", "hi", "slo", "shi", "anchors"]
    for batch in batches:
        seeds = batch.column(2).flatten()
        x, y = (seeds.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
        cluster = clusters(row, x, y)
        order = np.argsort(cluster, kind="stable")
        heads = np.flatnonzero(np.diff(cluster[order], prepend=-1))
        (x0, y0, low), (x1, y1, high) = (
            [take.reduceat(v[order], heads) if len(heads) else v for v in (x, y, y - x)] for take in (np.minimum, np.maximum))
        row = row[order][heads]
        doc, src = (batch.column(k).to_numpy()[row] for k in (0, 1))
        low, high = low - EDITS, high + EDITS
        high = np.where(doc == src, np.minimum(high, -1), high)
        # In steps, so that clusters at about one place share their words.
        lo, slo = (np.maximum(0, v - MIN_WORDS) // 32 * 32 for v in (x0, y0))
        hi, shi = ((v + 2 * MIN_WORDS) // 32 * 32 + 32 for v in (x1, y1))
        some = low <= high
        kinds = [pa.int64()] * 2 + [pa.int32()] * 4
        columns = [pa.array(c[some], type=t) for c, t in zip((doc, src, lo, hi, slo, shi), kinds, strict=True)]
        bands = pa.array(np.stack([low, high], axis=1)[some].ravel(), type=pa.int32())
        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1) * 2, type=pa.int32()), bands))
        yield pa.RecordBatch.from_arrays(columns, names)


def _may_be_near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a window of ``a`` has so many words, and COMMON runs of Q words, that ``b`` has as well."""
    if min(len(a), len(b)) < MIN_WORDS - EDITS:
        return False

    def most(left: np.ndarray, right: np.ndarray, size: int) -> int:
        held, size = np.r_[0, np.cumsum(np.isin(left, right))], min(size, len(left))
        return (held[size:] - held[:-size]).max()

    if most(a, b, MIN_WORDS) < MIN_WORDS - EDITS:
        return False
    a, b = a.astype(np.int64), b.astype(np.int64)
    left, right = (w[:-2] * 1_000_003 + w[1:-1] * 7_368_787 + w[2:] for w in (a, b))
    return most(left, right, GRAMS) >= COMMON


def _together(pairs: list[Pair]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of like sizes at once: which, their words a, the words of b from diagonal ``low`` on, widths of bands.

    Of each a row, the widest band first; shorter ones are filled up with words that nothing equals.
    """
    shape = [(len(a), high - low + 1) for a, _, low, high in pairs]
    order, at = sorted(range(len(pairs)), key=shape.__getitem__), 0
    while at < len(order):
        stop, n, width = at, MIN_WORDS, 1
        while stop < len(order):
            n, width = max(n, shape[order[stop]][0]), max(width, shape[order[stop]][1])
            if stop > at and (stop + 1 - at) * n * width > CELLS:
                break
            stop += 1
        some = sorted(order[at:stop], key=lambda i: -shape[i][1])
        at, n = stop, max(MIN_WORDS, *(shape[i][0] for i in some))
        width = shape[some[0]][1]
        left = np.full((len(some), n), 1 << 40, dtype=np.int64)
        right = np.full((len(some), n + width - 1), -(1 << 40), dtype=np.int64)
        for row, i in enumerate(some):
            a, b, low, _ = pairs[i]
            left[row, : len(a)] = a
            first, last = max(0, low), min(len(b), low + n + width - 1)
            if first < last:
                right[row, first - low : last - low] = b[first:last]
        yield some, left, right, np.array([shape[i][1] for i in some])


def dense(pairs: list[Pair]) -> np.ndarray:
    """Whether IDENTITY of the words of some part of a stand in b on the diagonals of the band.

    Without such a part there is no passage: of one of 2 * MIN_WORDS words or more, one half holds as much.
    """
    out = np.zeros(len(pairs), dtype=bool)
    for some, left, right, widths in _together(pairs):
        n = left.shape[1]
        hits = np.zeros(left.shape, dtype=bool)
        for k in range(widths[0]):
            rows = int(np.searchsorted(-widths, -k))  # whose band is wider than k
            hits[:rows] |= right[:rows, k : k + n] == left[:rows]
        # Five times the matches less four times the words rises by 0 or more over such a part.
        score = np.zeros((len(some), n + 1 + MIN_WORDS), dtype=np.int64)
        score[:, 1 : n + 1] = 5 * np.cumsum(hits, axis=1) - 4 * np.arange(1, n + 1)
        score[:, n + 1 :] = -5 * n
        ahead = np.lib.stride_tricks.sliding_window_view(score, MIN_WORDS, axis=1).max(axis=2)[:, MIN_WORDS:]
        out[some] = (ahead >= score[:, : ahead.shape[1]]).any(axis=1)
    return out


def local_paths(pairs: list[Pair]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Best local alignments of a and b on the diagonals of the band: their starts, their columns.

    A match scores 1, an edit -1; a column is (word of a, word of b, match) as zeros and ones.
    """
    out: list = [None] * len(pairs)
    for some, left, right, widths in _together(pairs):
        n, width = left.shape[1], int(widths[0])
        places = np.arange(width, dtype=np.int32)
        band = (places < widths[:, None]).astype(np.int32)
        scores = np.zeros((n + 1, len(some), width), dtype=np.int32)
        for i in range(n):
            last = scores[i]
            score = last + np.where(right[:, i : i + width] == left[:, i, None], np.int32(1), np.int32(-1))
            score[:, :-1] = np.maximum(score[:, :-1], last[:, 1:] - 1)
            score = np.maximum.accumulate(np.maximum(score, 0) + places, axis=1) - places
            scores[i + 1] = score * band
        for row, which in enumerate(some):
            a, b = left[row].tolist(), right[row].tolist()
            own = scores[:, row]
            i, k = (int(v) for v in np.unravel_index(int(own.argmax()), own.shape))
            own, columns = own[: i + 1].tolist(), []
            while (score := own[i][k]) > 0:
                same = b[i - 1 + k] == a[i - 1]
                if score == own[i - 1][k] + (1 if same else -1):
                    columns.append((1, 1, int(same)))
                    i -= 1
                elif k + 1 < width and score == own[i - 1][k + 1] - 1:
                    columns.append((1, 0, 0))
                    i, k = i - 1, k + 1
                else:
                    columns.append((0, 1, 0))
                    k -= 1
            out[which] = i, i + pairs[which][2] + k, columns[::-1]
    return out


def best_part(columns: np.ndarray) -> tuple[int, int] | None:
    """The part of an alignment that is a passage and has the most matches: first column, last + 1."""
    total = np.r_[np.zeros((1, 3), np.int64), np.cumsum(columns, axis=0)]
    same = np.flatnonzero(columns[:, 2])
    best, found = 0, None
    if len(same) == 0:
        return None
    pieces = [same] if len(columns) <= COLUMNS else [same[[0, -1]]] + [
        same[(same >= at) & (same < at + COLUMNS)] for at in range(0, len(columns), COLUMNS // 2)]
    for piece in pieces:
        mine, theirs, matched = (total[piece + 1, c] - total[piece, c, None] for c in range(3))
        long = np.maximum(mine, theirs)
        matched = np.where((long >= MIN_WORDS) & (matched >= IDENTITY * long), matched, 0)
        if matched.size and matched.max() > best:
            best = int(matched.max())
            first, last = np.nonzero(matched == best)
            pick = np.argmin(long[first, last])
            found = int(piece[first[pick]]), int(piece[last[pick]]) + 1
    return found


def near_spans(a: np.ndarray, b: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, source start, source end, matched words) of the near passages of a in b."""
    return all_near_spans([(a, b, low, high)])[0]


def all_near_spans(pairs: list[Pair]) -> list[list[tuple[int, int, int, int, int]]]:
    """:func:`near_spans` of every pair.  What lies beside an alignment is sought again, of all pairs together."""
    out: list[list] = [[] for _ in pairs]
    left = [(which, 0, len(pair[0])) for which, pair in enumerate(pairs)]
    while left:
        pieces = [(pairs[which][0][begin:stop], pairs[which][1], pairs[which][2] + begin, pairs[which][3] + begin)
                  for which, begin, stop in left]
        may = [i for i in np.flatnonzero(dense(pieces)).tolist() if _may_be_near(*pieces[i][:2])]
        left, pieces = [left[i] for i in may], [pieces[i] for i in may]
        more = []
        for (which, begin, stop), (own, b, _, _), (x, y, path) in zip(left, pieces, local_paths(pieces), strict=True):
            if not path:
                continue
            columns = np.array(path)
            ex, ey = x + int(columns[:, 0].sum()), y + int(columns[:, 1].sum())
            # Both ends go on along their diagonals: a passage may end in more edits than matches.
            back, on = min(x, y, MIN_WORDS), min(len(own) - ex, len(b) - ey, MIN_WORDS)
            ends = [np.stack([np.ones(len(s), np.int64)] * 2 + [s.astype(np.int64)], axis=1) for s in (
                own[x - back : x] == b[y - back : y], own[ex : ex + on] == b[ey : ey + on])]
            columns = np.concatenate([ends[0], columns, ends[1]])
            if part := best_part(columns):
                before, inside = columns[: part[0]].sum(axis=0), columns[part[0] : part[1]].sum(axis=0)
                x, y = x - back + int(before[0]), y - back + int(before[1])
                ex = x + int(inside[0])
                out[which].append((begin + x, begin + ex, y, y + int(inside[1]), int(inside[2])))
            more += [(which, begin, begin + x), (which, begin + ex, stop)]
        left = [piece for piece in more if piece[2] - piece[1] >= MIN_WORDS - EDITS]
    return out


def _pairs(batch: pa.RecordBatch) -> list[Pair]:
    """The words and bands of (doc, src, lo, slo, anchors, words, source_words) rows."""
    lo, slo, bounds = (batch.column(i).to_pylist() for i in (2, 3, 4))
    return [(batch.column(5)[i].values.to_numpy(), batch.column(6)[i].values.to_numpy(),
             low + lo[i] - slo[i], high + lo[i] - slo[i]) for i, (low, high) in enumerate(bounds)]


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(dense(_pairs(batch))))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "source_doc_id", "start", "end", "source_start", "source_end", "matched"]
    for batch in batches:
        doc, src, lo, slo = (batch.column(i).to_pylist() for i in range(4))
        out = [(doc[i], src[i], lo[i] + start, lo[i] + end, slo[i] + source, slo[i] + stop, matched)
               for i, spans in enumerate(all_near_spans(_pairs(batch))) for start, end, source, stop, matched in spans]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names)


def _sliced(df: DataFrame, key: str, slices: int) -> list[DataFrame]:
    """The rows of ``df`` by the values of ``key``, as slices of which each has all rows of its values."""
    return [df.where(F.expr(f"pmod(xxhash64({key}), {slices}) = {i}")) for i in range(slices)]


def _near_pairs(kept: DataFrame, n: int) -> list[DataFrame]:
    """Every own one of ``n`` seeds joined to its earlier places."""
    out = []
    for some in _sliced(kept, "h", min(SLICES, n // SLICE_ROWS + 1)):
        earlier = some.select("h", F.col("doc").alias("src"), F.col("pos").alias("spos"), F.col("before").alias("sbefore"))
        pairs = some.where("own").join(earlier, "h").where(
            "(src < doc OR (src = doc AND spos < pos)) AND (before IS NULL OR sbefore IS NULL OR before != sbefore)")
        out.append(written(pairs.select("doc", "src", "pos", "spos"), "pairs"))
    return out


def _near_passages(texts: DataFrame, reported: DataFrame) -> DataFrame:
    """Near passages of which FREE words or more of a window lie outside what is reported.

    Runs of Q words that stand twice are counted; the rare ones of every window, as
    :func:`rare_grams` picks them, are joined to all their earlier places.
    """
    spans = reported.select(F.col("doc_id").alias("doc"), "start", "end", F.expr(
        "matched = end - start AND matched = source_end - source_start").alias("exact")).distinct()
    kept = written(frequent_runs(texts, Q, MIN_WORDS - EDITS, spans, _select,
                                 "h long, doc long, pos int, own boolean, before long"), "grams")
    n = kept.count()
    joined = _near_pairs(kept, n)
    discard(kept)
    pairs, clustered = functools.reduce(DataFrame.unionByName, joined), []
    for some in _sliced(pairs, "doc", pairs.count() // max(SLICE_ROWS, n // RUNS_A_PAIR) + 1):
        grouped = some.groupBy("doc", "src").agg(F.collect_set(F.struct("pos", "spos")).alias("seeds"))
        clustered.append(written(grouped.mapInArrow(
            _cluster, "doc long, src long, lo int, hi int, slo int, shi int, anchors array<int>"), "clusters"))
    discard(*joined)
    found, near = functools.reduce(DataFrame.unionByName, clustered), []
    spans = sum(found.agg(*(F.approx_count_distinct(F.xxhash64(*c)) for c in (("doc", "lo", "hi"), ("src", "slo", "shi")))).first())
    parts = spans // max(SPANS, n // RUNS_A_SPAN) + 1
    for part in (part for docs in _sliced(found, "doc, 1", parts) for part in _sliced(docs, "src, 1", parts)):
        cut, own = _cut_spans(texts, part), part.count()
        passes = own // max(CLUSTERS, n // RUNS_A_CLUSTER) + 1
        for some, mine in zip(_sliced(part, "doc", passes), _sliced(cut, "doc", passes), strict=True):
            rows = _with_words(some, cut, mine)
            rows = rows.mapInArrow(_dense, rows.schema)
            # Small rows, long work: dealt by number.
            rows = rows.repartition(own // passes // CLUSTERS + 1, "doc", "src", "lo", "slo")
            near.append(written(rows.mapInArrow(_near, reported.schema).distinct(), "near"))
        discard(cut)
    discard(*clustered)
    near = functools.reduce(DataFrame.unionByName, near)
    inside = reported.select(F.col("doc_id").alias("doc"), F.col("start").alias("low"), F.col("end").alias("high"))
    return near.join(inside, F.expr("doc_id = doc AND low <= start AND end <= high"), "left_anti")


def _cut_spans(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The words of both spans of the rows of ``found``, each once."""
    spans = found.select("doc", "lo", "hi").unionByName(
        found.select(F.col("src").alias("doc"), F.col("slo").alias("lo"), F.col("shi").alias("hi")))
    spans = spans.distinct()
    parts = spans.groupBy("doc").agg(F.ceil(F.count("*") / REQUESTS).alias("parts"))
    wanted = spans.join(parts, "doc").groupBy(
        "doc", F.expr("pmod(xxhash64(lo, hi), parts)").alias("part")).agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = texts.join(wanted, "doc").select("doc", "text", "spans")
    return written(cut.mapInArrow(_cut, "doc long, lo int, hi int, words array<int>"), "spans")


def _with_words(found: DataFrame, cut: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of ``found`` with the words of their two spans: of ``own`` the one, of ``cut`` the source's."""
    theirs = cut.select(F.col("doc").alias("src"), F.col("lo").alias("slo"), F.col("hi").alias("shi"),
                        F.col("words").alias("source_words"))
    rows = found.join(theirs, ["src", "slo", "shi"]).join(own, ["doc", "lo", "hi"])
    return rows.select("doc", "src", "lo", "slo", "anchors", "words", "source_words")


def fuzzy_passages(docs: DataFrame) -> DataFrame:
    """Passages of a document that stand, exactly or nearly, at an earlier place.

    One row per passage: doc_id, start, end (words, end exclusive), source_doc_id, source_start,
    source_end, matched (words in common order).  A passage has at least MIN_WORDS words, of
    which IDENTITY match; words are compared with A-Z lower-cased.

    Seeds that occur twice or more are kept.  Each occurrence is joined to the earliest one of
    its seed (smallest doc_id, then place), so a passage of n copies gives n - 1 links to its
    original, not n * n.  Per document and source the matches are chained, chains are cut at wide
    gaps, and what is long enough is aligned word by word.  Where the parts of a passage stand in
    different earlier documents, its seeds are dealt to all of them; so every run of MIN_WORDS
    equal words that no passage holds is then joined to the earliest place of the whole run.

    Every run of 50 equal words is found.  Chains find what K + W equal words or luck lead to; what they
    leave is sought by the rare runs of Q words of every window, joined to all their earlier places.
    That filter is exact: no two passages of MIN_WORDS words, at most EDITS of them inserted, deleted
    or replaced, escape it, if FREE words or more lie in no passage reported before.  Such a passage
    begins and ends with matched words; it gets a row for every earlier place it is near to, exact
    copies of a still earlier one aside.

    NULL and short texts have no passages; rows with a NULL doc_id take no part.  Rows that repeat
    a doc_id are one document.  Extra columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string"))
    texts = texts.where("doc IS NOT NULL")
    seeds = texts.mapInArrow(_seeds, "h long, doc long, pos int")
    shared = seeds.select("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # Written, so that the join deals both sides out anew and Spark may split a very common seed.
    shared = written(shared, "shared")
    held = written(seeds.join(shared, "h"), "seeds")
    discard(shared)
    first = written(
        held.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("first")), "originals")
    matches = held.join(first, "h").where("doc != first.doc OR pos != first.pos").select(
        "doc", F.col("first.doc").alias("src"), F.struct("pos", F.col("first.pos").alias("spos")).alias("m"))
    grouped = matches.groupBy("doc", "src").agg(F.collect_set("m").alias("seeds"))
    found = written(grouped.mapInArrow(
        _chain, "doc long, src long, lo int, hi int, slo int, shi int, anchors array<int>"), "chains")
    discard(first)
    kinds = "doc_id long, source_doc_id long, start long, end long, source_start long, source_end long, matched long"
    cut = _cut_spans(texts, found)
    near = written(_with_words(found, cut, cut).mapInArrow(_align, kinds), "passages")
    discard(found, cut)
    reported = near.unionByName(_exact_passages(texts, held, near))
    return reported.unionByName(_near_passages(texts, reported))
