"""Vectorised byte-level tokenising and hashing shared by the text operators.

A batch of texts is joined into one byte array; word borders and a 64-bit
polynomial hash of every word come out of a handful of numpy passes, so no
Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))

#: Bytes of a word: ASCII letters, digits, underscore (UTF-8 bytes of other letters on demand).
ASCII_WORD = np.zeros(256, bool)
ASCII_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
ANY_WORD = ASCII_WORD.copy()
ANY_WORD[128:] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base modulo 2**64 and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        both = []
        for base in (_BASE, _UNBASE):
            p = np.empty(m, U)
            p[0], have, step = 1, 1, base
            while have < m:
                p[have : 2 * have] = p[:have] * U(step)
                step, have = step * step % 2**64, 2 * have
            both.append(p)
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise hashes so that every bit depends on every bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def splitmix(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h + U(salt * 0x9E3779B97F4A7C15 % 2**64))


@dataclass
class Words:
    """Words of a batch: byte borders, hash, and for each text its range of words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1: words of text i are first[i]:first[i + 1]


def hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every range of bytes."""
    p, q = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    value = _BYTE[b]
    value *= p[:-1]
    np.cumsum(value, out=total[1:])
    return mix((total[end] - total[start]) * q[start])


def words(raw: list[bytes], is_word: np.ndarray = ASCII_WORD) -> Words:
    """Split every byte string into its longest runs of word bytes."""
    n = len(raw)
    joined = b"\n".join(raw) + b"\n"
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, n)) if n else np.zeros(0, np.int64)
    b = np.frombuffer(joined, np.uint8)
    w = np.frombuffer(joined.translate(is_word.tobytes()), bool)
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    if len(w) and w[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    h = hashes(b, start, end)
    first = np.concatenate(([0], np.searchsorted(start, ends, "left"))).astype(np.int64)
    return Words(start, end, h, first)


def chunks(texts: list, most: int = 1 << 21):
    """Ranges of consecutive texts of about ``most`` characters in all (one text at least)."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        n = len(x)
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``k`` consecutive words of one text, and the text each belongs to."""
    n = np.diff(w.first)
    text = np.repeat(np.arange(len(n)), n)
    m = len(w.hash) - k + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = text[:m] == text[k - 1 :]
    h = np.zeros(m, U)
    for i in range(k):
        h = mix(h * U(3) + w.hash[i : i + m])  # not symmetric, so the order of words counts
    return h[inside], text[:m][inside]


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the half-open ranges, and the range each came from."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), which
