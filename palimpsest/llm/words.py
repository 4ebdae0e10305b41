"""Words and n-grams of Arrow text columns, as numpy arrays over whole slices of a batch.

Every rule used here draws its word borders from single ASCII characters, so UTF-8 can be cut at bytes.
A word's hash is a 64-bit polynomial over random byte values with a mixed finish; the n-gram hash chains
word hashes. Two different words share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, _MASK, 256, dtype=np.uint64)
_LOWERED = _BYTE_VALUES.copy()
_LOWERED[0x41:0x5B] = _BYTE_VALUES[0x61:0x7B]
_powers: dict[str, np.ndarray] = {}


def _power(n: int, kind: str) -> np.ndarray:
    """The first n powers of the base or of its inverse; kept for the worker's next slices."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        factors = np.full(max(n, SLICE_BYTES + 1), step, np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if n <= SLICE_BYTES * 4:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish of splitmix64: a bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts(NamedTuple):
    """Rows first..last of a batch: their UTF-8 bytes and where each begins (one more entry than rows)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    #: index of the first word of each row; one more entry than rows
    bounds: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column's rows in order, about `most` bytes at a time; nulls read as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(ends, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield Texts(first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(texts: Texts, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of the kind; a run never goes on in the next row."""
    inside = kind[texts.data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts.offsets), np.int64))
    begins = texts.offsets[:-1]
    begins = begins[begins < len(inside)]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[begins] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[begins[begins > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _BYTE_VALUES)[data] * _power(len(data), "up"), out=total[1:])
    inverse = _power(len(data) + 1, "down")  # an empty span may stand at the end
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_least(values: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """For the windows that ngrams(whole=True) gives, the least of their words' values."""
    counts = np.diff(bounds)
    got = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    ends = np.cumsum(got)
    row = np.repeat(np.arange(len(counts)), got)
    at = bounds[:-1][row] + np.arange(len(row)) - (ends - got)[row]
    last = bounds[1:][row] - 1
    out = values[at]
    for j in range(1, n):
        out = np.minimum(out, values[np.minimum(at + j, last)])
    return out


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each row, in order, and where each row's begin.

    whole: a row of fewer words, but not none, has one window of all of them.
    """
    counts = np.diff(bounds)
    got = np.maximum(counts - n + 1, 0)
    if whole:
        short = (counts > 0) & (counts < n)
        got = got + short
    out_bounds = np.concatenate([[0], np.cumsum(got)])
    row = np.repeat(np.arange(len(counts)), got)
    at = bounds[:-1][row] + np.arange(out_bounds[-1]) - out_bounds[:-1][row]
    out = np.zeros(len(at), np.uint64)
    length = np.minimum(counts[row], n).astype(np.int64) if whole else np.full(len(at), n)
    for j in range(n):
        if whole:
            use = j < length
            out[use] = mix(out[use] * np.uint64(_BASE) + hashes[at[use] + j])
        else:
            out = mix(out * np.uint64(_BASE) + hashes[at + j])
    return out, out_bounds


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and where each row's begin."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(bounds) - 1))]).astype(np.int64)
