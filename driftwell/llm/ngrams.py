"""Hashed byte n-grams of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLOCK = 1 << 18
#: Odd multipliers of the byte positions, fixed so that models and texts agree.
_SPREAD = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393)]


def hashed(raw: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Bucket (``bits`` bits) of every window of ``width`` bytes."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    wide = raw.astype(np.uint32) + np.uint32(1)
    out = wide[:n] * _SPREAD[0]
    for j in range(1, width):
        out = (out ^ (out >> np.uint32(15))) * _SPREAD[j % 5] + wide[j : n + j]
    out = (out ^ (out >> np.uint32(13))) * np.uint32(0x9E3779B1)
    return (out >> np.uint32(32 - bits)).astype(np.int64)


def pieces(data: bytes, width: int) -> Iterator[np.ndarray]:
    """A text's bytes in pieces of bounded length that overlap by ``width`` - 1."""
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, max(len(raw) - width + 1, 1), _BLOCK):
        yield raw[at : at + _BLOCK + width - 1]
