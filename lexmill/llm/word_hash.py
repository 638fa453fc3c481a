"""Hashes of words and of runs of words, for whole columns of text at once.

A word is a maximal run of bytes that are no white space. Its hash is a polynomial over its bytes
modulo 2^64, taken from running sums over the text, then mixed. Equal words have equal hashes
wherever they stand; different words differ but for the usual chance of 64 bits.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 18
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers


def word_hashes(text: bytes, fold: bool) -> np.ndarray:
    """Hash of every word of UTF-8 ``text``, in order; ``fold`` lower-cases A to Z."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > _BLOCK:  # cut at white space, so that memory does not follow the text
            end = at + _BLOCK
            while end < len(text) and not _IS_SPACE[text[end]]:
                end += 1
        out.append(_block_hashes(np.frombuffer(text, np.uint8, end - at, at), fold))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _block_hashes(raw: np.ndarray, fold: bool) -> np.ndarray:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(raw) + 1)
    values = (_FOLD[raw] if fold else raw).astype(np.uint64)
    values += np.uint64(1)
    values *= power[: len(raw)]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, length, np.uint64)
    for i in range(length):
        total = total * np.uint64(_BASE) + words[i : i + n]
    return mix(total)


def shingle_set(text: bytes, length: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``length`` folded words; of a shorter text, the whole sequence."""
    words = word_hashes(text, True)
    if not len(words):
        return words
    return np.unique(run_hashes(words, min(length, len(words))))
