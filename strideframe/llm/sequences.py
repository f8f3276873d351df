"""Numpy over many documents at once: bytes and words as number sequences, window hashes, minima."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: A hash that stands for "no window here".
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text behind the other, and where each begins and the
    last one ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def portions(column: pa.Array, size: int = 2 << 20):
    """(first, end) rows of a string column, so that a portion's texts have about ``size`` bytes; numpy then
    works on a portion at a time.  A longer text is a portion of its own."""
    _, offsets = utf8(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, len(column))
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of every k consecutive values: by doubling, hash(2m)[i] =
    hash(m)[i] * base**m + hash(m)[i + m]."""
    n = len(values) - k + 1
    if n <= 0 or not k:
        return np.zeros(max(n, 0), np.uint64)
    whole, size, part, m = None, 0, values, 1
    while True:
        if k & m:
            if whole is None:
                whole, size = part, m
            else:
                whole = whole[:len(values) - size - m + 1] * np.uint64(pow(_BASE, m, 1 << 64)) + part[size:len(values) - m + 1]
                size += m
        if size == k:
            return whole
        part = part[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + part[m:]
        m *= 2


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, translate: np.ndarray | None = None):
    """Maximal runs of bytes with ``is_word`` (a table of 256 booleans) within each text: start, end (in
    ``data``), 64-bit hash, and the number of words before each text (one more entry: of all)."""
    if not len(data):
        return (*(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[cuts] |= inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    ends[cuts] |= inside[cuts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return start, end, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    size = end - start
    powers = np.full(int(size.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.flatnonzero(inside)
    used = data[place] if translate is None else translate[data[place]]
    first = np.cumsum(size) - size
    value = _BYTES[used] * powers[np.arange(len(place)) - np.repeat(first, size)]
    hashes = mix(np.add.reduceat(value, first) + size.astype(np.uint64))
    return start, end, hashes, np.searchsorted(start, offsets)


def within(n: int, size: int, starts: np.ndarray) -> np.ndarray:
    """Which of the windows of ``size`` of n values lie within one document; documents begin at
    ``starts`` (the last entry is n)."""
    ok = np.ones(max(n - size + 1, 0), bool)
    if size > 1:
        edge = np.zeros(n + 1, np.int32)
        inner = starts[1:-1]
        np.add.at(edge, np.maximum(inner - size + 1, 0), 1)  # windows from here on to inner - 1 cross inner
        np.add.at(edge, inner, -1)
        ok &= np.cumsum(edge)[:len(ok)] == 0
    return ok


def sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every w consecutive values."""
    part, m = values, 1
    while 2 * m <= w:
        part = pick(part[:-m], part[m:])
        m *= 2
    rest = w - m
    return pick(part[:len(part) - rest], part[rest:]) if rest else part


def minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some window of w hashes (or of all, if there are fewer);
    ties are all kept.  NONE is never kept.  Equal windows thus keep equal positions."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    low = sliding(hashes, min(w, n), np.minimum)
    w = min(w, n)
    wide = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    high = sliding(wide, w, np.maximum)  # of the windows that hold a position, the largest minimum
    return np.flatnonzero((hashes == high) & (hashes != NONE))


def spans(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Maximal runs of True within each text."""
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(mask)]
    begins[cuts] |= mask[cuts]
    return sums(begins, offsets)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def cover(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``size`` that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge)[:n] > 0
