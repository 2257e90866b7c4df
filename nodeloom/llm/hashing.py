"""Vectorised hashes of the words and byte windows of many texts at once.

A word's hash is a polynomial over random 64-bit byte values, taken as a difference of prefix sums modulo 2**64 and then
mixed. Different words agree with a chance of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = BYTES.copy()
FOLDED[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
WINDOW = 1 << 19
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, WINDOW + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the rows' offsets in them; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if int(lengths.sum()) != int(offsets[-1] - offsets[0]):
            keep = [data[a : a + n] for a, n in zip(offsets[:-1], lengths)]
            return np.concatenate(keep), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about WINDOW bytes that never part a word."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + WINDOW, n)
        if end < n:
            row_end = int(offsets[np.searchsorted(offsets, end)])
            while end < row_end and not SPACE[data[end - 1]]:
                ahead = SPACE[data[end : min(end + 4096, row_end)]]
                end = end + int(ahead.argmax()) + 1 if ahead.any() else end + len(ahead)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of each word of the rows, and the rows' offsets among the words.

    A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. The
    default table makes A-Z equal to a-z.
    """
    hashes, begins = [], []
    for a, b in _windows(data, offsets):
        part = data[a:b]
        inside = ~SPACE[part]
        cut = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[cut] = inside[cut]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[part] * powers(BASE, b - a), out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * powers(INVERSE, b - a)[starts] + (ends - starts).astype(np.uint64)))
        begins.append(starts + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = np.concatenate(begins)
    return np.concatenate(hashes), begins, np.searchsorted(begins, offsets)


def _coefficients(k: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, max(k, 64), dtype=np.uint64)[:k] * np.uint64(2) + np.uint64(1)


def windows_of_words(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word window within a row, and the rows' offsets among the windows.

    A row of fewer words has its whole sequence as its one window; a row without words has none.
    """
    n, c = len(hashes), _coefficients(k)
    counts = np.diff(rows)
    have = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_rows = np.concatenate([[0], np.cumsum(have)]).astype(np.int64)
    whole = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        if len(whole):
            whole += hashes[j : n - k + 1 + j] * c[j]
    out = np.zeros(int(out_rows[-1]), np.uint64)
    at = np.arange(len(out)) - np.repeat(out_rows[:-1], have) + np.repeat(rows[:-1], have)
    full = np.repeat(counts >= k, have)
    out[full] = mix(whole[at[full]] + np.uint64(k))
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        w = hashes[rows[r] : rows[r + 1]]
        out[out_rows[r]] = mix(np.array([(w * c[: len(w)]).sum() + np.uint64(len(w))], np.uint64))[0]
    return out, out_rows


def distinct_sets(values: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each row."""
    return [np.unique(values[a:b]) for a, b in zip(rows[:-1], rows[1:])]


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers for a sorted set; 128 bits in all."""
    if not len(values):
        return 0, 0
    place = np.arange(len(values), dtype=np.uint64)
    first = mix(values + place * np.uint64(BASE)).sum(dtype=np.uint64)
    second = mix((values ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(BASE) + place).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))
