"""Hashes of all words of many texts at once, with NumPy.

A word's hash is a polynomial in its bytes modulo 2**64. With prefix sums of
byte x power over the whole buffer, the hash of any span is one subtraction and
one product with the inverse power, so nothing loops over words.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", _P), ("i", _INV)):
            t = np.empty(size, np.uint64)
            t[0] = 1
            done = 1
            while done < size:
                t[done : 2 * done] = t[:done] * np.uint64(pow(base, done, 2**64))
                done *= 2
            _powers[name] = t
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(buf: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    word = np.empty(len(buf) + 2, np.int8)
    word[0] = word[-1] = 0
    np.logical_not(space[buf], out=word[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(word))
    return edge[0::2], edge[1::2]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p, inv = _tables(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=sums[1:])
    h = (sums[end] - sums[start]) * inv[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
