"""Rolling hashes of a text's bytes, and from them the set of its word shingles."""

from __future__ import annotations

import numpy as np

from .common import utf8

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2 ** 64."""
    if not _tables or len(_tables[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _tables[:] = []
        for b in (BASE, INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _tables.append(np.multiply.accumulate(x))
    return _tables[0][:n], _tables[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefixes(data: bytes) -> np.ndarray:
    """Hash sums of data[:i] for i from 0 to its length."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(max(1, len(x)))[0][: len(x)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes have equal hashes wherever they are."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the runs of `words` words; a text of fewer, but not none, is one run."""
    data = b" ".join(utf8(text).split())
    if not data:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    k = min(words, len(start))
    return np.unique(spans(prefixes(data), start[: len(start) - k + 1], end[k - 1 :]))
