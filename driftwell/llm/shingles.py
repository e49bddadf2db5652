"""Word shingles of whole texts as sorted arrays of 64-bit hashes, in numpy.

A word is a run of bytes other than the six white-space characters x20 and
x09-x0D; A-Z count as a-z.  A text with fewer than ``width`` words but at least
one has a single shingle, its whole word sequence; a text without words (null,
empty, white space only) has none.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = (step * step) & _MASK
    return out


_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _cache or len(_cache["up"]) < n:
        n = max(n, 1 << 16)
        _cache["up"] = _powers(_BASE, n)
        _cache["down"] = _powers(pow(_BASE, -1, 1 << 64), n)
    return _cache["up"], _cache["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of every word of a lower-cased UTF-8 text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.empty(0, dtype=np.uint64)
    up, down = _tables(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str | None], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's first word (n+1 offsets).

    ``fold``: A-Z count as a-z.
    """
    hashes, counts, at = [], np.zeros(len(texts), dtype=np.int64), 0
    while at < len(texts):
        block, size, first = [], 0, at
        while at < len(texts) and (not block or size < _BLOCK):
            raw = (texts[at] or "").encode("utf-8", "surrogatepass")
            block.append(raw.lower() if fold else raw)
            size += len(block[-1]) + 1
            at += 1
        start, found = _word_hashes(b" ".join(block))
        bounds = np.cumsum([0] + [len(x) + 1 for x in block])
        counts[first:at] = np.diff(np.searchsorted(start, bounds))
        hashes.append(found)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of ``width`` words."""
    words, bound = word_hashes(texts)
    if len(words) >= width:
        whole = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for j in range(width):
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - width + 1 + j]
        whole = mix(whole)
    else:
        whole = np.empty(0, np.uint64)
    out = []
    for i in range(len(texts)):
        a, b = int(bound[i]), int(bound[i + 1])
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = b - a
            for w in words[a:b].tolist():
                h = (h * 0xA0761D6478BD642F + w) & _MASK
            out.append(mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
