"""Word shingles of many texts at once, as 64-bit hashes (NumPy on Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of text hashed in one go; a longer text is a slice of its own.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, rows, bytes, offsets)`` of runs of rows with about ``limit`` bytes; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) and the row it is in."""
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    start = np.empty(len(data), dtype=bool)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    start[0] = True
    start[1:] = space[:-1]
    start = (start | first[:-1]) & ~space
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    # the place of each byte in its word gives the power of the base
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.concatenate(([0], at)), np.diff(np.concatenate(([0], at, [len(data)]))))
    value = np.where(space, np.uint64(0), _BYTE[_LOWER[data]])
    longest = int(place[~space].max()) + 1
    powers = np.cumprod(np.full(longest, _BASE, dtype=np.uint64))
    value *= powers[np.minimum(place, longest - 1)]
    return mix(np.add.reduceat(value, at)), np.searchsorted(offsets, at, side="right") - 1


def shingle_sets(texts: pa.Array, k: int = 3, limit: int = SLICE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes.

    A text with fewer words has its whole sequence as one shingle; one without words (or null) has none.
    """
    for _, rows, data, offsets in utf8_slices(texts, limit):
        words, row = word_hashes(data, offsets)
        n = len(words)
        bounds = np.searchsorted(row, np.arange(rows + 1))
        hashes = np.zeros(max(0, n - k + 1), dtype=np.uint64)
        for j in range(k):
            hashes += words[j : n - k + 1 + j] * _STEP[j] if n >= k else 0
        hashes = mix(hashes)
        for r in range(rows):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= k:
                yield np.unique(hashes[a : b - k + 1])
            elif b > a:
                short = (words[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.array([b - a], dtype=np.uint64)
                yield mix(short ^ _BASE)
            else:
                yield np.zeros(0, dtype=np.uint64)
