"""Words of byte strings: which bytes are in them, their lower case, and their shingles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .arrays import word_starts

SHINGLE = 5
_rng = np.random.default_rng(23)
_POWERS = _rng.integers(1, 1 << 62, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(1, 1 << 62, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin-1 letters; all else as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    out = table[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[upper] += 32
    return out


#: 1: a byte of a word (letters, digits, apostrophe, every byte over ASCII).
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
#: The same without the apostrophe.
PLAIN = IN_WORD.copy()
PLAIN[39] = False


@dataclass
class Shingled:
    """The words of a block of rows: byte span of each, row borders among them, and the shingle that starts at each word."""

    start: np.ndarray
    end: np.ndarray
    borders: np.ndarray
    shingle: np.ndarray  # of each word; zero where fewer than SHINGLE words of the row are left

    @staticmethod
    def of(data: np.ndarray, borders: np.ndarray) -> Shingled:
        none = np.zeros(0, np.int64)
        inside = PLAIN[data]
        if not inside.any():
            return Shingled(none, none, np.zeros(len(borders), np.int64), none.astype(np.uint64))
        first = word_starts(inside, borders)
        start = np.flatnonzero(first)
        letters = folded(data)[inside]
        sizes = np.diff(np.r_[np.flatnonzero(first[inside]), len(letters)])
        position = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        h = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _POWERS[position & 1023], np.cumsum(sizes) - sizes)
        h ^= h >> np.uint64(29)
        rows = np.searchsorted(start, borders)
        shingle = np.zeros(len(start), np.uint64)
        if len(start) >= SHINGLE:
            n = len(start) - SHINGLE + 1
            total = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                total += h[k : k + n] * _STEPS[k]
            shingle[:n] = (total ^ (total >> np.uint64(31))) | np.uint64(1)
            for back in range(1, SHINGLE):  # a shingle lies within its row
                cut = rows[1:] - back
                shingle[cut[(cut >= rows[:-1]) & (cut >= 0)]] = 0
        return Shingled(start, start + sizes, rows, shingle)
