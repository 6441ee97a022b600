"""Words and word hashes of many texts at once, on their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space between words, tab to carriage return and space.
IS_GAP = np.zeros(256, bool)
IS_GAP[[9, 10, 11, 12, 13, 32]] = True

STRETCH = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def lower_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z lowered, null as empty, and where each begins (n + 1)."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    wide = pa.types.is_large_string(lowered.type)
    _, offsets, data = lowered.buffers()
    n, at = len(lowered), lowered.offset
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[at:at + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (n + 1)."""
    inside = ~IS_GAP[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    fresh[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    size = max(2 * STRETCH, 1 << (length - 1).bit_length()) if length else 2 * STRETCH
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        both = []
        for base in (BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[size] = both[0], both[1]
    return _POWERS[size]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; worked off in stretches so long texts stay bounded."""
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        after = max(first + 1, int(np.searchsorted(ends, origin + STRETCH, "right")))
        piece = data[origin:ends[after - 1]].astype(np.uint64) + np.uint64(1)
        up, down = powers(len(piece))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(piece * up[:len(piece)],
                                                         dtype=np.uint64)])
        a, b = starts[first:after] - origin, ends[first:after] - origin
        hashes[first:after] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        first = after
    return mix(hashes)
