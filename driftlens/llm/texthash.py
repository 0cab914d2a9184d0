"""Vectorised hashing of texts inside tasks: bytes, words, word sequences."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, U)
_INVERSES = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _ODD
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTE = mix(np.arange(256, dtype=U))


def _grown(table: np.ndarray, factor: np.uint64, n: int) -> np.ndarray:
    grown = np.full(max(n, 2 * len(table)), factor, U)
    grown[0] = U(1)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(grown)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = _grown(_POWERS, _ODD, n)
    return _POWERS[:n]


def inverse_powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the inverse of that base."""
    global _INVERSES
    if len(_INVERSES) < n:
        _INVERSES = _grown(_INVERSES, U(pow(int(_ODD), -1, 1 << 64)), n)
    return _INVERSES[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows: the difference of two, times the inverse power of its start."""
    out = np.zeros(len(data) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[data] * powers(len(data)), out=out[1:])
    return out


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words between white space."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.empty(0, U)
    sums = prefix_sums(data)
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * inverse_powers(len(data))[starts] + (ends - starts).astype(U))


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words; with fewer words, of the whole sequence as one."""
    if not len(words):
        return np.empty(0, U)
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, U(k), U)
        for i in range(k):
            out = mix(out * _ODD + words[i:len(words) - k + 1 + i])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words, A-Z in lower case; null and blank texts have none."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    return np.unique(sequence_hashes(word_hashes(data), k))
