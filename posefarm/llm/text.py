"""Word and shingle fingerprints of many texts at once, in numpy.

A batch of texts is one byte buffer.  A word's fingerprint is a polynomial over randomly
drawn byte values modulo 2**64, read off a running sum, so no Python loop touches a
character.  Fingerprints are then scrambled, so sums and minima of them behave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_DRAWN = np.random.default_rng(20240229)
_BYTE = _DRAWN.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
DELIMITER = np.zeros(256, bool)
DELIMITER[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that are no letter or digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text handled at a time; a longer text is handled alone.
SLICE = 1 << 20

_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse, modulo 2**64."""
    if len(_powers[inverse]) < n:
        step = np.full(max(n, SLICE + 1), _BASE_INVERSE if inverse else _BASE, np.uint64)
        step[0] = 1
        _powers[inverse] = np.multiply.accumulate(step)
    return _powers[inverse][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    raw, at = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


def word_bounds(raw: np.ndarray, at: np.ndarray, delimiter: np.ndarray = DELIMITER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and for each text the number of words before it (one more entry at the end)."""
    inside = ~delimiter[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at[:-1]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, at)


def running(raw: np.ndarray) -> np.ndarray:
    """Running sums whose differences are the fingerprints of byte ranges."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte ranges begin:end."""
    return mix((sums[end] - sums[begin]) * powers(len(sums), True)[begin] + (end - begin).astype(np.uint64))


def words(raw: np.ndarray, at: np.ndarray, lower: bool = True, delimiter: np.ndarray = DELIMITER) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, and the place of each text's first word (one more entry at the end)."""
    begin, end, place = word_bounds(raw, at, delimiter)
    return range_hash(running(_LOWER[raw] if lower else raw), begin, end), place


_STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of every run of ``n`` neighbours (across texts too: see ``gram_places``)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = hashes[:len(hashes) - n + 1].copy()
    for k in range(1, n):
        total = total * _STEP + hashes[k:len(hashes) - n + 1 + k]
    return mix(total)


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct fingerprints of ``n``-word shingles of each text; a text of fewer
    words has its whole sequence as its one shingle, a text without words has none."""
    hashes, place = words(raw, at)
    runs = grams(hashes, n)
    out = []
    for a, b in zip(place[:-1].tolist(), place[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a:b - n + 1]))
        elif b > a:
            out.append(mix(grams(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
