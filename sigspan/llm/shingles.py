"""Sets of word shingles as sorted 64-bit hashes, computed over slices of text.

Words are runs of bytes other than blank and 9 to 13, with A-Z lower-cased. A word
is hashed by a polynomial over its bytes, a shingle by a polynomial over its words,
both finished by a mixing step; the hashes of all words of a slice come from one
running sum. Equal sets of shingles are taken to be equal sets of hashes.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, kept for the usual sizes."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        have = np.full(n + 1, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 22:
            _powers[int(base)] = have
    return have


def forget() -> None:
    """Drop the kept powers: 16 bytes for each byte of the largest slice so far."""
    _powers.clear()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of a text column given as bytes and row offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True  # a row starts here
    starts = np.flatnonzero(word & np.r_[True, ~word[:-1] | breaks[1:-1]])
    ends = np.flatnonzero(word & np.r_[~word[1:] | breaks[1:-1], True]) + 1
    total = np.cumsum(_BYTE[data] * _power(_BASE, n)[:n])
    hashes = (total[ends - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0))) * _power(_UNBASE, n)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    rows = len(offsets) - 1
    words, row = word_hashes(data, offsets)
    counts = np.bincount(row, minlength=rows)
    n = len(words)
    padded = np.concatenate([words, np.zeros(WORDS - 1, np.uint64)])
    parts = [padded[i : i + n] * _PLACE[i] for i in range(WORDS)]
    first = np.cumsum(counts) - counts
    left = (first + counts)[row] - np.arange(n)  # words from here to the end of the row
    if n and counts.min() < WORDS:  # a short row is one shingle: its words, and how many
        for i in range(1, WORDS):
            parts[i][left <= i] = 0
    hashes = parts[0]
    for part in parts[1:]:
        hashes = hashes + part
    short = counts < WORDS
    hashes = mixed(hashes + np.where(short, counts, WORDS).astype(np.uint64)[row])
    last = np.where(short, np.minimum(counts, 1), counts - WORDS + 1)
    return [np.unique(hashes[f : f + k]) for f, k in zip(first.tolist(), last.tolist())]
