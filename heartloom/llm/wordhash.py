"""Vectorised word splitting and hashing of UTF-8 text for use inside Arrow tasks.

A word is a maximal run of bytes outside a separator set. All separators are ASCII, so working on UTF-8 bytes gives
the same words as working on code points. A word's hash is a polynomial over its bytes modulo 2**64, taken from one
prefix sum over the text and finalised by a bit mixer; it needs no Python loop over words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Byte values with A-Z folded to a-z.
FOLDED = _BYTES.copy()
FOLDED[65:91] = _BYTES[97:123]

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def spans(data: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def hashes_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of characters, of which values has a random number each."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", _BASE, len(values)), out=total[1:])
    down = _power("down", _INVERSE, len(values) + 1)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand."""
    return hashes_of(values[data], starts, ends)


def shingles(text: bytes, k: int = 2, fold: bool = True) -> np.ndarray:
    """Distinct hashes of k consecutive words; of the whole sequence if there are fewer words; none without words."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    words = hashes(data, starts, ends, FOLDED if fold else _BYTES)
    k = min(k, len(words))
    out = words[: len(words) - k + 1]
    for i in range(1, k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - k + 1 + i])
    return np.unique(out)
