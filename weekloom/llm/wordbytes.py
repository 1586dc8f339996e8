"""Words, word hashes and shingles of whole Arrow text columns, with numpy on the UTF-8 bytes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. UTF-8 never uses
these bytes inside a character, so byte runs and character runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Rows of a slice at most, so that a row number fits the upper 12 bits of a shingle key.
SLICE_ROWS = 4096
SHINGLE_BITS = 52

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_draw = np.random.default_rng(7_340_033)
_BYTE = _draw.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_ORDER = _draw.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Slice(NamedTuple):
    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(column: pa.Array, limit: int = 1 << 18) -> Iterator[Slice]:
    """Runs of whole rows of about ``limit`` bytes; a longer row is a slice of its own."""
    data, at = text_buffers(column)
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + SLICE_ROWS, len(at) - 1)
        yield Slice(first, last, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one running polynomial sum."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=sums[1:])
    value = (sums[end] - sums[start]) * inverse[start]
    value += (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(value)


def words(part: Slice, lower: bool = True, apart: np.ndarray = SPACE) -> Words:
    """Every word of a slice in order; ``lower`` folds A-Z only; ``apart`` marks the bytes between words."""
    inside = ~apart[part.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[part.offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    doc = np.searchsorted(part.offsets, start, "right") - 1
    return Words(doc, start, end, span_hashes(part.data, start, end, lower))


def word_hash(word: str, lower: bool = True) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]), lower)[0])


def ngrams(w: Words, rows: int, width: int = 5, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """52-bit hashes of all ``width``-word n-grams in text order as (row, hash).

    With ``whole_short``, a row with fewer words has one, its whole sequence, after those of all other rows.
    """
    count = np.bincount(w.doc, minlength=rows)
    docs, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    n = len(w.hash) - width + 1
    if n > 0:
        value = np.full(n, width, np.uint64) * _ORDER[63]
        for k in range(width):
            value += w.hash[k : n + k] * _ORDER[k]
        whole = w.doc[:n] == w.doc[width - 1 :]
        docs.append(w.doc[:n][whole])
        values.append(value[whole])
    few = (count > 0) & (count < width)
    if whole_short and few.any():
        at = few[w.doc]
        first = np.cumsum(count) - count
        place = np.flatnonzero(at) - first[w.doc[at]]
        start = np.flatnonzero(place == 0)
        docs.append(w.doc[at][start])
        values.append(np.add.reduceat(w.hash[at] * _ORDER[place], start) + count[few].astype(np.uint64) * _ORDER[63])
    return np.concatenate(docs), mix(np.concatenate(values)) >> np.uint64(64 - SHINGLE_BITS)


def shingle_keys(w: Words, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row as (row, 52-bit hash), sorted by both.

    A row with fewer than ``width`` words has one shingle, its whole sequence; a row without words has none.
    """
    return distinct(*ngrams(w, rows, width))


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, 52-bit hash) pairs, sorted."""
    key = doc.astype(np.uint64) << np.uint64(SHINGLE_BITS) | value
    key.sort()
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint64(SHINGLE_BITS)).astype(np.int64), key & np.uint64((1 << SHINGLE_BITS) - 1)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs given by start and size."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def multipliers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n random linear hash functions modulo 2**64 (odd factor, offset)."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, dtype=np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
