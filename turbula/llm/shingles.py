"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept up to a million."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    m = max(n, 1 << 17)
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, x)]), dtype=np.uint64) for x in (_BASE, _BACK))
    if m <= 1 << 20:
        _powers[:] = [up, down]
    return up, down


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lowered, in order."""
    data = np.frombuffer(text.lower(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(data))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)
    part = total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))
    return mixed(part * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct ``width``-word shingles of a text, sorted; with fewer words, the whole sequence as one."""
    words = word_hashes(text)
    if not len(words):
        return words
    w = min(width, len(words))
    value = np.full(len(words) - w + 1, np.uint64(w))
    for i in range(w):
        value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - w + 1 + i])
    return np.unique(value)
