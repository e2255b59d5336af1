"""Words of Arrow text columns as hashes, without making Python strings.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. Hashes are values of polynomials at fixed points modulo the prime
2^31 - 1, taken as differences of running sums, so each word, and each window of words, costs the same few operations whatever its
length. A word's hash is of two points (62 bits), a print of four (124 bits); a finaliser mixes the bits. Running sums are taken in
blocks, so memory beside the text is that of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PRIME, _BITS = np.uint64((1 << 31) - 1), np.uint64(31)
#: Points of the polynomials over bytes and over words.
BYTE_POINTS, WORD_POINTS = (0x3C6EF372, 0x54FF53A5), (0x1B873593, 0x4CC9E2D5, 0x27D4EB2F, 0x165667B1)
#: Powers kept of a point; values summed up at a time.
BLOCK, GROUP = 1 << 14, 1 << 20
AT_A_TIME = 500_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=32)
def _powers(point: int) -> np.ndarray:
    """point ** i modulo the prime, for i up to BLOCK."""
    out, x, p = np.empty(BLOCK + 1, np.uint64), 1, int(PRIME)
    for i in range(BLOCK + 1):
        out[i] = x
        x = x * point % p
    return out


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, by adding what lies above 31 bits."""
    x = (x & PRIME) + (x >> _BITS)
    x = (x & PRIME) + (x >> _BITS)
    return x - PRIME * (x >= PRIME)


def _power(point: int, at: np.ndarray) -> np.ndarray:
    """point ** at, digit by digit to the base BLOCK."""
    at = at.astype(np.int64)
    out = _powers(point)[at % BLOCK]
    while len(at) and int((at := at // BLOCK).max()):
        point = int(_powers(point)[BLOCK])
        out = _mod(out * _powers(point)[at % BLOCK])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _sums(values: np.ndarray, point: int, places: np.ndarray) -> np.ndarray:
    """At each place, the sum of value * point ** index over the values before it. Bytes count one more than they are; others are below the prime."""
    out, up = np.zeros(len(places), np.uint64), _powers(point)[:BLOCK]
    step, factor, before = int(_powers(point)[BLOCK]), 1, 0
    order = None if len(values) <= GROUP else np.argsort(places, kind="stable")
    ordered = places if order is None else places[order]
    for lo in range(0, len(values), GROUP):
        some = values[lo : lo + GROUP]
        width = min(BLOCK, len(some))
        grid = np.zeros(-(-len(some) // width) * width, np.uint64)
        grid[: len(some)] = some
        if values.dtype == np.uint8:
            grid[: len(some)] += np.uint64(1)
        grid = grid.reshape(-1, width)
        grid *= up[:width]
        if values.dtype != np.uint8:
            # below 2^32, so that a block's sum stays below 2^46
            grid = (grid & PRIME) + (grid >> _BITS)
        np.cumsum(grid, axis=1, out=grid)
        factors, offsets = np.empty(len(grid), np.uint64), np.empty(len(grid), np.uint64)
        for b, total in enumerate(_mod(grid[:, -1]).tolist()):
            factors[b], offsets[b] = factor, before
            before = (before + factor * total) % int(PRIME)
            factor = factor * step % int(PRIME)
        if order is None:
            mine = np.flatnonzero(places)
        else:
            a, z = np.searchsorted(ordered, [lo + 1, lo + len(some) + 1])
            mine = order[a:z]
        last = places[mine] - (lo + 1)
        block = last // width
        out[mine] = _mod(offsets[block] + factors[block] * _mod(grid.reshape(-1)[last]))
    return out


def _polynomials(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, point: int) -> np.ndarray:
    """Of values[start:end] for each range."""
    sums = _sums(values, point, np.concatenate([starts, ends]))
    return _mod(_mod(sums[len(starts) :] + PRIME - sums[: len(starts)]) * _power(pow(point, -1, int(PRIME)), starts))


def _pair(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(high << np.uint64(31) | low)


def _lane(words: np.ndarray, i: int) -> np.ndarray:
    """Words as values of 31 bits, for each point others."""
    return mix(words ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(33)


def of_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes."""
    return _pair(*(_polynomials(data, starts, ends, p) for p in BYTE_POINTS))


def bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts one after the other, start and end of each word in them, and the number of words of each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    ink = ~_IS_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = ink[edges]
    starts = np.flatnonzero(first)
    last = ink.copy()
    last[:-1] &= ~ink[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return data, starts, ends, counts


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each text."""
    data, starts, ends, counts = bounds(texts)
    return of_bytes(data, starts, ends), counts


def of_ranges(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of words."""
    return _pair(*(_polynomials(_lane(words, i), starts, ends, p) for i, p in enumerate(WORD_POINTS[:2])))


def prints(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each range of words, in two halves."""
    a, b, c, d = (_polynomials(_lane(words, i), starts, ends, p) for i, p in enumerate(WORD_POINTS))
    return _pair(a, b), _pair(c, d)


def places(counts: np.ndarray, k: int) -> np.ndarray:
    """First word's index, among all words, of each window of k words within a text."""
    ends = np.cumsum(counts)
    m = np.maximum(counts - (k - 1), 0)
    return np.arange(int(m.sum())) + np.repeat(ends - counts - (np.cumsum(m) - m), m)


def windows(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k words within a text, and its first word's index among all words."""
    at = places(counts, k)
    return of_ranges(words, at, at + k), at


def in_parts(batch: pa.RecordBatch, column: int, size: int = AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some ``size`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        n = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, n - at)
        at = n
