"""Vectorised tokenising: words and their 64-bit hashes straight from Arrow's string buffers.

A word's hash is a polynomial in random odd byte values modulo 2**64, taken from one
running sum over the bytes, then mixed. Two different words share a hash with a chance of
about 2**-58, so hashes stand for words wherever counts or sets of words are compared.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BLOCK = 1 << 20
_RATIO = 0x9E3779B97F4A7C13  # 3 modulo 8
_INVERSE = pow(_RATIO, -1, 1 << 64)


def _trimmer():
    """glibc's ``malloc_trim``; elsewhere nothing."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0
    pa.set_memory_pool(pa.system_memory_pool())
    return trim


_TRIM = _trimmer()


def trim() -> None:
    """What is free goes back to the system."""
    _TRIM(0)


def _class(delimiters: list[tuple[int, int]]) -> np.ndarray:
    kept = np.ones(256, bool)
    for a, b in delimiters:
        kept[a : b + 1] = False
    return kept


#: [^\x20\x09-\x0D]
NONSPACE = _class([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, r, np.uint64)])) for r in (_RATIO, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text.

    What the batch before left free goes back to the system: Python workers live on from stage to stage beside a full heap.
    """
    trim()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the index of each document's first word (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kept[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[:-1]
    before[edge[edge < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edge = offsets[1:] - 1
    after[edge[edge >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word, A-Z as a-z. Works block by block, so that memory follows the longest word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a + 1)
        run = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUES[data[a:b]] * up[: b - a], out=run[1:])
        s = starts[i:j] - a
        out[i:j] = (run[ends[i:j] - a] - run[s]) * down[s]
        i = j
    return mix(out)


def codepoint_index(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    return np.searchsorted(heads, positions)


def grouped_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs: run k is values[first[k]:first[k + 1]]; an empty run sums to 0."""
    run = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]
