"""Hashed five-word shingles of whole Arrow batches, in numpy.

Words are runs of bytes other than ASCII white space, ASCII letters in lower case. The hash of a word is a polynomial over its bytes
modulo 2^64, taken from running sums, so a batch costs a few passes over its bytes, whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Multipliers of the hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.arange(256, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_VALUE = (_VALUE + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, BASE, dtype=np.uint64), np.full(size, BASE_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def forget_powers() -> None:
    """Drops the tables of powers, which are as long as the longest text so far."""
    _powers.clear()


def texts(column: pa.Array, most_bytes: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices (first row, bytes, offsets) of a string column, each of about ``most_bytes``, whose arrays fit a processor's cache, unless a text is longer; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_ranges(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end byte) of every word; a word ends where its text does."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    blank = space[data]
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = blank[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = blank[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    return np.flatnonzero(first & ~blank), np.flatnonzero(last & ~blank) + 1


def range_hashes(data: np.ndarray, *ranges: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Hashes of byte ranges (first, end), without regard to the case of ASCII letters."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return [mix((sums[ends] - sums[starts]) * down[starts]) for starts, ends in ranges]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each text): the second has one entry more than there are texts."""
    starts, ends = word_ranges(data, offsets)
    return range_hashes(data, (starts, ends))[0], np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes of each text one after the other, bounds). A text of 1 to k - 1 words has one shingle."""
    counts = np.diff(bounds)
    padded = np.concatenate([words, np.zeros(k, dtype=np.uint64)])
    total = np.zeros(len(words), dtype=np.uint64)
    for j in range(k):
        total += padded[j : j + len(words)] * STEPS[j]
    total = mix(total)
    out, ends = [], np.zeros(len(counts) + 1, dtype=np.int64)
    for i, n in enumerate(counts.tolist()):
        b = bounds[i]
        if n >= k:
            out.append(np.sort(total[b : b + n - k + 1]))
        elif n:
            out.append(mix(np.array([(words[b : b + n] * STEPS[:n]).sum() + np.uint64(n)], dtype=np.uint64)))
        ends[i + 1] = ends[i] + max(n - k + 1, min(n, 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), ends


def occurrences(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Elements that make a bag a set: the q-th occurrence of a hash within a text has an element of its own."""
    if not len(hashes):
        return hashes
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][bounds[:-1] < len(hashes)]] = False
    if not same.any():
        return hashes
    place = np.arange(len(hashes))
    run = np.maximum.accumulate(np.where(same, 0, place))
    q = (place - run).astype(np.uint64)
    return np.where(q > 0, mix(hashes + q * np.uint64(0x2545F4914F6CDD1D)), hashes)
