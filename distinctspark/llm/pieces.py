"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from distinctspark.llm.words import list_array, mix

#: Where the public vocabulary lies; a parameter of ``load``.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text worked on at once, in characters; a longer document is taken alone.
CHUNK_CHARS = 1 << 19
MARK = 0x2581  # stands for a space within pieces
_LITERAL = 0x7FFFFFF0  # a mark that was in the text itself; no code point is so large
_NONE = np.int32(-(1 << 31))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FILTER_BITS = 20


@dataclass
class Pieces:
    """A vocabulary: text pieces by their hashes, byte pieces, and the bytes each id decodes to."""

    hashes: np.ndarray  # sorted, of all text pieces, and some that no piece has
    owners: np.ndarray  # their ids
    first: np.ndarray  # of each value of a hash's top bits: the first place with it, or after it
    sieve: np.ndarray  # if any hash has these top bits
    crowd: int  # hashes that share their top bits, at most
    lengths: np.ndarray  # of pieces, in characters, rising
    ids: list[np.ndarray]  # the pieces of each of these lengths
    weights: np.ndarray  # log weight of each id
    bytes_from: int  # id of byte 0
    text: list[bytes]  # what an id decodes to, marks as spaces

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h`` that are hashes of pieces, their ids)."""
        top = h >> np.uint64(64 - _FILTER_BITS)
        maybe = np.flatnonzero(self.sieve[top])
        h, at = h[maybe], self.first[top[maybe]]
        hit = self.hashes[at] == h
        for _ in range(1, self.crowd):
            at = np.where(hit, at, at + 1)
            hit = self.hashes[at] == h
        return maybe[hit], self.owners[at[hit]]


def _hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers): hash of [a, b) is (sum[b] - sum[a]) * power[a]."""
    n = len(codes)
    up = np.cumprod(np.full(n + 1, _BASE, dtype=np.uint64))
    down = np.cumprod(np.full(n + 1, _INVERSE, dtype=np.uint64))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return sums, down


def load(path: str = MODEL, zipf: float = 1.0) -> Pieces:
    """Read a SentencePiece vocabulary with byte pieces, on the driver only.

    The files of merges carry ranks, not probabilities, so a piece of rank r weighs
    (r + 2) ** -zipf over their sum.  A byte piece weighs as the rarest piece.  Pieces with a mark
    behind another character are left out: segments end before a mark.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size, by_length, text, byte_ids = model.vocab_size(), {}, [b""] * model.vocab_size(), {}
    rank = np.full(size, size, dtype=float)
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            text[i] = bytes([int(piece[1:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i)):
            text[i] = piece.replace(chr(MARK), " ").encode()
            rest = piece.lstrip(chr(MARK))
            if chr(MARK) in rest or (rest and piece.startswith(chr(MARK) * 2)):
                continue
            rank[i] = i - len(byte_ids)
            by_length.setdefault(len(piece), []).append((i, piece))
    if sorted(byte_ids) != list(range(256)) or byte_ids[255] - byte_ids[0] != 255:
        raise ValueError("the vocabulary needs a run of 256 byte pieces")
    weights = -zipf * np.log(rank + 2)
    weights -= np.log(np.exp(weights).sum())
    lengths = sorted(by_length)
    ids = [np.array([i for i, _ in by_length[n]], dtype=np.int32) for n in lengths]
    hashes = []
    for _, piece in (own for n in lengths for own in by_length[n]):
        sums, down = _hash(np.array([ord(c) for c in piece], dtype=np.uint32))
        hashes.append(mix(sums[-1:] * down[:1]))
    hashes = np.concatenate(hashes)
    order = np.argsort(hashes)
    hashes, owners = hashes[order], np.concatenate(ids)[order]
    tops = (hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
    counts = np.bincount(tops, minlength=1 << _FILTER_BITS)
    first = (np.cumsum(counts) - counts).astype(np.int32)
    crowd = int(counts.max())
    # Probes may run past the end.
    hashes, owners = np.r_[hashes, np.zeros(crowd, np.uint64)], np.r_[owners, np.zeros(crowd, np.int32)]
    return Pieces(hashes, owners, first, counts > 0, crowd, np.array(lengths), ids, weights, byte_ids[0], text)


@dataclass
class Lattice:
    """Distinct segments laid end to end; edges sorted by (end within segment, segment)."""

    start: np.ndarray  # node each edge leaves; node p is the place before character p
    ids: np.ndarray  # its piece, or -1 - character code where it is spelled in bytes
    cumulative: np.ndarray  # rank of the node it enters + share of the edges up to this one
    first: np.ndarray  # of each node: its first edge
    rank: np.ndarray  # of each node: its place in the edges' order


def lattice(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> Lattice:
    """Edges of all segments and, by the forward filter, their shares in the node they enter.

    With A(node) the log of the summed weight of all ways to spell the segment up to a node, an
    edge's share is exp(A(its start) + its weight - A(its end)).
    """
    n = len(codes)
    sums, down = _hash(codes)
    origin = np.repeat(starts.astype(np.int32), ends - starts)
    # One row a character, one column a length, the longest first: read by rows, edges are in the
    # order of their end and start.
    lengths = pieces.lengths
    edge = np.full((n, len(lengths)), _NONE, dtype=np.int32)
    single = np.zeros(n, dtype=bool)
    at = np.arange(n, dtype=np.int32)
    room = np.repeat(ends.astype(np.int32), ends - starts) - at
    low, power = sums[:-1], down[:-1]
    for column, length in zip(range(len(lengths) - 1, -1, -1), lengths.tolist(), strict=True):
        fits = np.flatnonzero(room >= length)
        if len(fits) == 0:
            break
        at, room, low, power = at[fits], room[fits], low[fits], power[fits]
        hit, ids = pieces.find(mix((sums[at + length] - low) * power))
        found = at[hit]
        edge[found + (length - 1), column] = ids
        if length == 1:
            single[found] = True
    spelled = np.flatnonzero(~single)
    edge[spelled, -1] = -1 - codes[spelled].view(np.int32)
    flat = edge.reshape(-1)
    where = np.flatnonzero(flat != _NONE)
    last = (where // len(lengths)).astype(np.int32)
    ids, end = flat[where], last + np.int32(1)
    length = lengths[::-1].astype(np.int32)[where - last.astype(np.int64) * len(lengths)]
    start = end - length
    weight = pieces.weights[np.maximum(ids, 0)]
    low = np.flatnonzero(ids < 0)
    code = -1 - ids[low]
    n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    weight[low] = np.where(code == _LITERAL, 3, n_bytes) * pieces.weights[pieces.bytes_from]
    depth = end - origin[last]  # end within its segment
    if len(depth) and depth.max() < 1 << 16:  # short keys have a linear sort
        order = np.argsort(depth.astype(np.uint16), kind="stable")
    else:
        order = np.argsort(depth, kind="stable")
    start, end, ids, weight, depth = (x[order] for x in (start, end, ids, weight, depth))
    heads = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else np.zeros(0, np.int64)
    # Nodes are entered in the order of their depth; a segment's own start has A = 0.
    total = np.zeros(n + 1)
    share = np.empty(len(end))
    levels = np.searchsorted(depth[heads], np.arange(1, int(depth[-1]) + 2)) if len(end) else [0]
    bounds = np.r_[heads, len(end)]
    inner = start > origin[np.minimum(start, n - 1)]  # edges from a segment's start add nothing
    for low, high in zip(levels[:-1], levels[1:], strict=True):
        a, b = bounds[low], bounds[high]
        if a == b:
            continue
        score = weight[a:b] + np.where(inner[a:b], total[start[a:b]], 0.0)
        sizes = np.diff(bounds[low : high + 1])
        top = np.maximum.reduceat(score, heads[low:high] - a)
        part = np.exp(score - np.repeat(top, sizes))
        whole = np.add.reduceat(part, heads[low:high] - a)
        total[end[heads[low:high]]] = top + np.log(whole)
        share[a:b] = part / np.repeat(whole, sizes)
    sizes = np.diff(bounds)
    running = np.cumsum(share)
    running -= np.repeat(running[heads] - share[heads], sizes)
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[end[heads]] = np.arange(len(heads))
    first = np.zeros(n + 1, dtype=np.int64)
    first[end[heads]] = heads
    last = heads + sizes - 1
    running[last] = 1.0  # no rounding at the end
    return Lattice(start, ids, running + np.repeat(np.arange(len(heads)), sizes), first, rank)


def _uniform(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from (row key, place in the text): the same on every run."""
    h = mix(mix(keys) + places.astype(np.uint64) * _BASE)
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


def _spelled(code: int) -> bytes:
    return chr(MARK if code == _LITERAL else code).encode("utf-8", "surrogatepass")


def encode_texts(texts: list[str], keys: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """One sampled segmentation per text, as ids.

    A text gets a mark in front and marks for spaces.  A segment is a run of marks with what
    follows up to the next; no piece crosses its ends, so each is sampled by itself: backwards
    from its end, an edge entering the node is drawn by its share.  Equal segments share a lattice.
    """
    joined = "".join(" " + t for t in texts if t)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    if len(codes) == 0:
        return [np.zeros(0, np.int32)] * len(texts)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts])
    row_starts = np.cumsum(np.r_[0, lengths])
    space = codes == 32
    codes[codes == MARK] = _LITERAL
    codes[space] = MARK
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[row_starts[:-1][lengths > 0]] = True
    starts = np.flatnonzero(begins)
    ends = np.r_[starts[1:], len(codes)]
    row = np.searchsorted(row_starts, starts, "right") - 1

    sums, down = _hash(codes)
    names = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    _, example, which = np.unique(names, return_index=True, return_inverse=True)
    sizes = (ends - starts)[example]
    own_ends = np.cumsum(sizes)
    own_starts = own_ends - sizes
    take = np.arange(own_ends[-1]) - np.repeat(own_starts - starts[example], sizes)
    net = lattice(codes[take], own_starts, own_ends, pieces)

    # Occurrences by segment, so that lookups run through memory in order.
    occurrence = np.argsort(which, kind="stable")
    segment = which[occurrence]
    node, begin = own_ends[segment], own_starts[segment]
    key = keys[row[occurrence]]
    # A node's place in its text: what the sampling is seeded with.
    shift = starts[occurrence] - begin - row_starts[row[occurrence]]
    active = np.arange(len(node))
    steps, counts = [], np.zeros(len(node), dtype=np.int64)
    while len(active):
        now = node[active]
        u = _uniform(key[active], now + shift[active])
        edge = np.searchsorted(net.cumulative, net.rank[now] + u, "right")
        edge = np.maximum(edge, net.first[now])
        ids = net.ids[edge]
        size = np.ones(len(ids), dtype=np.int64)
        low = np.flatnonzero(ids < 0)
        spelled = [_spelled(-1 - int(i)) for i in ids[low]]
        size[low] = [len(s) for s in spelled]
        steps.append((active, ids, size, low, spelled))
        counts[active] += size
        node[active] = net.start[edge]
        active = active[node[active] > begin[active]]

    in_order = np.empty(len(counts), dtype=np.int64)
    in_order[occurrence] = counts
    offsets = np.cumsum(np.r_[0, in_order])
    stop = offsets[1:][occurrence].copy()
    out = np.empty(offsets[-1], dtype=np.int32)
    for active, ids, size, low, spelled in steps:
        stop[active] -= size
        to = stop[active]
        plain = ids >= 0
        out[to[plain]] = ids[plain]
        for i, letters in zip(low, spelled, strict=True):
            for j, byte in enumerate(letters):
                out[to[i] + j] = pieces.bytes_from + byte
    bounds = offsets[np.searchsorted(starts, row_starts)]
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def decode_ids(ids: np.ndarray, pieces: Pieces) -> str:
    """The text that was encoded: the pieces' bytes, without the mark put in front."""
    text = pieces.text
    return b"".join([text[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def _row_keys(column: pa.Array, seed: int) -> np.ndarray:
    ids = column.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed) * _BASE)


def _encoder(key_at: int, text_at: int, pieces: Pieces, seed: int) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = _row_keys(batch.column(key_at), seed), batch.column(text_at)
            first = 0
            while first < batch.num_rows:
                chunk, size = [], 0
                while first + len(chunk) < batch.num_rows and size < CHUNK_CHARS:
                    chunk.append(texts[first + len(chunk)].as_py())
                    size += len(chunk[-1] or "")
                ids = encode_texts(chunk, keys[first : first + len(chunk)], pieces)
                own = batch.slice(first, len(chunk))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, list_array(ids, pa.int32())], [*batch.schema.names, "ids"])
                first += len(chunk)

    return encode


def _decoder(ids_at: int, pieces: Pieces) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(ids_at)
            texts = [None if row is None else decode_ids(row, pieces)
                     for row in (x.values.to_numpy() if x.is_valid else None for x in ids)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, type=pa.string())],
                [*batch.schema.names, "decoded"])

    return decode


def encode(docs: DataFrame, pieces: Pieces, seed: int = 0) -> DataFrame:
    """``docs`` with ``ids``: a segmentation of the whole text, sampled by its weight.

    The draw is seeded by (seed, doc_id, place in the text), so it does not depend on partitions
    or reruns, and rows equal in doc_id and text get equal ids.  A NULL or empty text gives no
    ids, a NULL doc_id a key of its own.  Characters without a piece are spelled in byte pieces.
    All columns pass through; a column ``ids`` is replaced.
    """
    docs = docs.drop("ids")
    schema = T.StructType(list(docs.schema)).add("ids", T.ArrayType(T.IntegerType()))
    names = docs.columns
    return docs.mapInArrow(_encoder(names.index("doc_id"), names.index("text"), pieces, seed), schema)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with ``decoded``, the exact text behind ``ids`` (NULL stays NULL, none is '')."""
    encoded = encoded.drop("decoded")
    schema = T.StructType(list(encoded.schema)).add("decoded", "string")
    return encoded.mapInArrow(_decoder(encoded.columns.index("ids"), pieces), schema)
