"""Word and shingle hashing of Arrow text columns in numpy, whole texts at a time.

A word is a maximal run of bytes outside space and 0x09-0x0D.  Those bytes never occur inside a
multi-byte UTF-8 character, so words of bytes are words of characters.  Hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULTIPLIERS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, xor, multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.cumprod(np.full(n, _BASE, dtype=np.uint64)) * _BASE_INVERSE
            cls.down = np.cumprod(np.full(n, _BASE_INVERSE, dtype=np.uint64)) * _BASE
        return cls.up[:n], cls.down[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    binary = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)
    offsets = offsets[binary.offset : binary.offset + len(binary) + 1]
    body = binary.buffers()[2]
    if body is None or len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(binary) + 1, np.int64)
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """The words of the rows ``first`` to ``last`` (exclusive) of a column."""

    first: int
    last: int
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # byte offset of each word within the chunk
    ends: np.ndarray  # exclusive
    offsets: np.ndarray  # words of row first + i: offsets[i] to offsets[i + 1]
    data: np.ndarray  # bytes of the chunk
    rows: np.ndarray  # byte offsets of the rows within the chunk

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.offsets))


def word_chunks(column: pa.Array, lower: bool = True) -> Iterator[Words]:
    """Hash every word of a text column, in chunks of whole rows."""
    data, offsets = text_bytes(column)
    n, first = len(column), 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(n, max(last, first + 1))
        yield _words(data[offsets[first] : offsets[last]], offsets[first : last + 1], first, last, lower)
        first = last


def _words(data: np.ndarray, offsets: np.ndarray, first: int, last: int, lower: bool) -> Words:
    rows = offsets - offsets[0]
    n = len(data)
    raw = data
    if lower:
        data = _LOWER[data]
    inner = ~_SPACE[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inner
    before[rows] = False  # a row's end ends its last word
    starts = np.flatnonzero(inner & ~before[:-1])
    after = np.zeros(n + 1, dtype=bool)
    after[:-1] = inner
    after[rows] = False
    ends = np.flatnonzero(inner & ~after[1:]) + 1
    up, down = _Powers.of(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:n], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(first, last, hashes, starts, ends, np.searchsorted(starts, rows), raw, rows)


def prefix_hashes(words: Words, length: int, lower: bool = True) -> np.ndarray:
    """Hash of the first ``length`` bytes of every word."""
    data = _LOWER[words.data] if lower else words.data
    up, down = _Powers.of(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=prefix[1:])
    ends = np.minimum(words.starts + length, words.ends)
    return mix((prefix[ends] - prefix[words.starts]) * down[words.starts] - np.uint64(length))


def window_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of every window of ``k`` words within a row."""
    h = words.hashes
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for j in range(k):
        total += h[j : j + len(total)] * _MULTIPLIERS[j]
    row = words.row_of()
    at = np.flatnonzero(row[: len(total)] == row[k - 1 :])
    return mix(total[at]), at


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per row, its sorted distinct ``k``-word shingles; the whole sequence where it is shorter."""
    hashes, at = window_hashes(words, k)
    cut = np.searchsorted(at, words.offsets)
    sets = []
    for i in range(words.last - words.first):
        own = hashes[cut[i] : cut[i + 1]]
        low, high = words.offsets[i], words.offsets[i + 1]
        if len(own) == 0 and high > low:
            short = words.hashes[low:high]
            own = mix((short * _MULTIPLIERS[: len(short)]).sum(keepdims=True) + np.uint64(high - low))
        sets.append(np.unique(own))
    return sets


def list_array(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """An Arrow list column of one numpy array per row."""
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    if parts:
        np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))
