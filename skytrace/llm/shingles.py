"""Word shingles as 64-bit hashes, for whole batches of texts at once.

Only sets of two documents are ever compared, so a hash collision could matter with a chance of about
(words of both)^2 / 2^65 a pair.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the base of the polynomial hash with its inverse modulo 2^64.
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i up to ``n``."""
    global _POWERS, _INVERSES
    if len(_POWERS) <= n:
        size = max(1 << 16, n + n // 4)
        _POWERS, _INVERSES = np.full(size + 1, _BASE, np.uint64), np.full(size + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        for x in (_POWERS, _INVERSES):
            x[0] = 1
            np.multiply.accumulate(x, out=x)
    return _POWERS[: n + 1], _INVERSES[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, inverses): the hash of data[s:e] is (P[e] - P[s]) * inverses[s]."""
    p, inv = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
    return total, inv


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, lower-cased A-Z, in order; number of its text)."""
    joined = b"\n".join(texts).translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _SPACE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[0::2], edge[1::2]
    total, inv = prefix_hash(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mix((total[end] - total[start]) * inv[start]), np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles; a shorter text is one shingle, one without words none."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    h = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + len(h)]
    h = mix(h)
    out = []
    for i, n in enumerate(counts.tolist()):
        s = first[i]
        if n >= k:
            out.append(np.unique(h[s : s + n - k + 1]))
        elif n:
            x = np.zeros(1, np.uint64)
            for w in words[s : s + n]:
                x = x * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(mix(x + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
