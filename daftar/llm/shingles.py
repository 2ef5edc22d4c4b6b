"""Sets of word shingles as sorted 64-bit hashes, computed on whole arrays of bytes."""

from __future__ import annotations

import hashlib

import numpy as np

SLICE = 1 << 20  # bytes hashed at a time, so that a very long text needs no large arrays
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.cumprod(np.full(64, _BASE, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread evenly (the finishing step of a 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _place(longest: int) -> np.ndarray:
    global _powers
    if longest > len(_powers):
        _powers = np.cumprod(np.full(2 * longest, _BASE, dtype=np.uint64))
    return _powers


def _words(data: np.ndarray) -> np.ndarray:
    inside = np.flatnonzero(~_SPACE[data])
    if not len(inside):
        return np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    sizes = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    values = _BYTE[data[inside]] * _place(int(sizes.max()))[place]
    return mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; none for null or blank text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) <= SLICE:
        return _words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # a slice ends before white space
            gaps = np.flatnonzero(_SPACE[data[end : end + SLICE]])
            end = end + int(gaps[0]) if len(gaps) else min(end + SLICE, len(data))
        parts.append(_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of a shorter text, its whole sequence."""
    words = word_hashes(text)
    if not len(words):
        return words
    runs = max(1, len(words) - width + 1)
    total = np.full(runs, np.uint64(min(width, len(words))))
    for k in range(min(width, len(words))):
        total = total + words[k : k + runs] * _PLACE[k]
    return np.unique(mixed(total))


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
