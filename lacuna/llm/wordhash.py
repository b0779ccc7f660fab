"""64-bit codes of words and of word windows, for whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words a worker remembers; beyond it words are hashed afresh, not dropped.
MEMO_WORDS = 400_000
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BITS = 1 << 64


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = code
        return code


_memo = _Memo()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but ASCII blanks; ``lower`` maps A-Z only."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, _BITS), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def window_codes(codes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A code for each window of ``size`` words, by a rolling polynomial.

    ``which`` picks one of two independent bases: both codes together are 128 bits.
    """
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    base = _BASE[which]
    up, down = _power_tables(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes + np.uint64(which)) * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def shingles(text: str | None, size: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct codes of the ``size``-word windows of a whole text.

    A text with fewer words has one shingle, all of its words; one without words none.
    """
    words = words_of(text, lower)
    if not words:
        return np.zeros(0, np.uint64)
    codes = codes_of(words)
    return np.unique(window_codes(codes, min(size, len(words))) + np.uint64(min(size, len(words))))
