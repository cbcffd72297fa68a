"""Words and word n-grams of whole Arrow batches of texts, as 64-bit hashes in numpy.

A word is a run of bytes outside space and tab ... carriage return, unchanged. All functions
work on slices of a batch of about a megabyte (a longer text is a slice of its own), so that
memory follows the longest text and not the batch. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_STEP_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; kept up to a few slices' length."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[int(base)] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all 64 bits."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Words:
    """Words of consecutive texts: byte places, hashes, and where each text's words begin."""

    data: np.ndarray
    text_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of up to ``limit`` bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for row, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, row
            total, begin = 0, row
        total += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(places) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0]:places[-1]], places - places[0]


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between ``start`` and ``end``."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(_STEP, len(data)), out=total[1:])
    h = (total[end] - total[start]) * powers(_STEP_INVERSE, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words of all texts of a slice; ``lower`` turns A-Z into a-z first."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | breaks[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | breaks[1:-1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, run_hashes(data, start, end), np.searchsorted(start, offsets))


def windows(words: Words, k: int, seed: int = 0x2545F4914F6CDD1D) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the place of each run's first word."""
    h, n = words.hash, len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = _U(seed | 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(base, n), out=total[1:])
    inverse = _U(pow(int(base), -1, 2**64))
    hashes = mix((total[k:] - total[:-k]) * powers(inverse, n)[:n - k + 1] + _U(k))
    last = np.repeat(words.first[1:], np.diff(words.first))
    inside = np.flatnonzero(np.arange(n - k + 1) + k <= last[:n - k + 1])
    return hashes[inside], inside


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles.

    A text of fewer words is one shingle; one without words has none.
    """
    hashes, places = windows(words, k)
    cuts = np.searchsorted(places, words.first)
    counts = np.diff(words.first)
    sets = []
    for i, n in enumerate(counts):
        if n >= k:
            sets.append(np.unique(hashes[cuts[i]:cuts[i + 1]]))
        elif n:
            part = words.hash[words.first[i]:words.first[i + 1]]
            value = np.zeros(1, np.uint64)
            for h in part:
                value = mix(value * _STEP + h)
            sets.append(mix(value + _U(int(n))))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
