"""Vectorised tokenising and hashing of a batch of UTF-8 texts with numpy.

A batch is one flat byte array with text boundaries. Hashes are polynomials modulo 2**64, taken as differences of prefix
sums: no Python loop runs over bytes or words.
"""
from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base or of its inverse."""
    key = "i" if inverse else "b"
    if key not in _powers or len(_powers[key]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        p = np.full(size, INVERSE if inverse else BASE, np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (None: empty), and where each begins; the last entry is the end."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return np.frombuffer(b"".join(parts), np.uint8), ends


def prefix_sums(b: np.ndarray) -> np.ndarray:
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(len(b)), out=s[1:])
    return s


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes; equal contents have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), True)[start])


def words(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes that aren't ASCII white space) and each text's first word's index."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < len(b))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, ends)


def shingles(texts, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles of lower-case (A-Z only) words, sorted within the text, and each text's
    first one's index. A text of fewer words has its whole word sequence as its one shingle; without words it has none."""
    b, ends = flat(texts)
    b = _LOWER[b]
    start, end, first = words(b, ends)
    h = spans_hash(prefix_sums(b), start, end)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    if (n >= width).all():
        skipped = np.repeat(first[:-1] - begin[:-1], count)
        at = np.arange(begin[-1]) + skipped
        length = None
    else:
        at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
        length = np.repeat(np.minimum(n, width), count)
    out = np.zeros(len(at), np.uint64) if length is None else (length - width).astype(np.uint64)
    for i in range(width):
        if length is None:
            out = mix(out * BASE + h[at + i])
        else:
            more = np.flatnonzero(length > i)
            out[more] = mix(out[more] * BASE + h[at[more] + i])
    for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
        out[a:z].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[:-1][count > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[begin]
