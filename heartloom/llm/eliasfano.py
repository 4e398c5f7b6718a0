"""Elias-Fano lists of character boundaries: where each code point of a UTF-8 text begins, in about two bits each.

A list holds n + 1 rising byte offsets, the text's length last. The low bits of each are packed as they are, the high
bits in unary in one bit row; a directory with the number of ones before every block of 64 bytes makes ``select`` a
search in the directory and one in the block.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQB")
_BLOCK = 64  # bytes of the bit row between two directory entries


def boundaries(text: bytes) -> np.ndarray:
    """Byte offsets at which code points begin, and the length; bytes that continue a code point begin none."""
    data = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def encode(values: np.ndarray) -> bytes:
    """The list of at least one rising (or equal) non-negative numbers."""
    n, top = len(values), int(values[-1])
    low = max(0, (top // n).bit_length() - 1)
    v = values.astype(np.uint64)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    row = np.zeros((int(ones[-1]) // (_BLOCK * 8) + 1) * _BLOCK * 8, np.uint8)
    row[ones] = 1
    high = np.packbits(row, bitorder="little")
    before = np.concatenate(([0], np.cumsum(row.reshape(-1, _BLOCK * 8).sum(1, dtype=np.int64))[:-1])).astype("<u8")
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return _HEAD.pack(n, len(high), low) + before.tobytes() + high.tobytes() + np.packbits(bits.ravel(), bitorder="little").tobytes()


def size(code: bytes) -> int:
    """How many numbers the list holds."""
    return _HEAD.unpack_from(code)[0]


def select(code: bytes, i: int) -> int:
    """The i-th number of an encoded list, from 0."""
    n, width, low = _HEAD.unpack_from(code)
    if not 0 <= i < n:
        raise IndexError(f"{i} of {n}")
    blocks = width // _BLOCK
    before = np.frombuffer(code, "<u8", blocks, _HEAD.size)
    b = int(np.searchsorted(before, i, "right")) - 1
    at = _HEAD.size + 8 * blocks
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, _BLOCK, at + b * _BLOCK), bitorder="little"))
    high = b * _BLOCK * 8 + int(ones[i - int(before[b])]) - i
    if not low:
        return high
    first = i * low
    part = np.frombuffer(code, np.uint8, (first + low + 7) // 8 - first // 8, at + width + first // 8)
    bits = np.unpackbits(part, bitorder="little")[first % 8 : first % 8 + low]
    return (high << low) | int((bits.astype(np.int64) << np.arange(low)).sum())
