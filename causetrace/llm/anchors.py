"""Content-chosen anchors: for every window of a byte string, the q-gram in it with the least hash."""

from __future__ import annotations

import numpy as np

#: Bytes of position in a sort key; the rest is hash.
_POS_BITS = 24
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


#: Bytes hashed at once; longer texts are cut into overlapping chunks.
BUFFER = 1 << 19
_POWER = np.cumprod(np.concatenate(([np.uint64(1)], np.full(BUFFER, _BASE, dtype=np.uint64))))
_INVERSE = np.cumprod(np.concatenate(([np.uint64(1)], np.full(BUFFER, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64))))


class Spans:
    """Hashes of any byte range of a buffer in constant time (polynomial over randomised byte values, modulo 2^64, mixed)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _POWER[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal ranges get equal values wherever they stand: the base is odd, so its powers can be divided out."""
        return _mix((self.sums[end] - self.sums[start]) * _INVERSE[start])


def buffer_of(data: bytes) -> np.ndarray:
    if len(data) > BUFFER:
        raise ValueError("longer than a buffer")
    return np.frombuffer(data, dtype=np.uint8)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size : w - size + len(x) - w + 1]) if size < w else m


def runs(spans: Spans, bounds: list[tuple[int, int]], window: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, last window start, anchor) of every run of windows that choose the same anchor.

    ``bounds`` are the byte ranges of the texts in the buffer; windows lie within one text. Of equal
    hashes in a window the leftmost wins, so equal windows choose equal anchors.
    """
    if not bounds:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e
    end = max(b for _, b in bounds)
    at = np.arange(end - q + 1, dtype=np.int64)
    if end < window:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e
    key = spans.of(at, at + q)
    key &= ~np.uint64((1 << _POS_BITS) - 1)
    key |= at.astype(np.uint64)
    least = sliding_min(key, window - q + 1)
    anchor = (least & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    inside = np.zeros(end + 1, dtype=bool)
    for a, b in bounds:
        if b - a >= window:
            inside[a : b - window + 1] = True
    inside = inside[: len(anchor)]
    start = np.flatnonzero(inside & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~inside[:-1])))
    last = np.flatnonzero(inside & np.concatenate(((anchor[1:] != anchor[:-1]) | ~inside[1:], [True])))
    return start, last, anchor[start]
