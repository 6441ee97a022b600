"""Golomb-Rice code of sorted values, written and read by array operations only."""

from __future__ import annotations

import numpy as np


def encode(sorted_values: np.ndarray, span: int) -> bytes:
    """Code of the gaps of sorted values in [0, span).

    One byte for the parameter (the bits of a remainder: the binary logarithm of the mean gap),
    then all quotients in unary, each ended by a one, then all remainders.
    """
    shift = max(0, int(span / max(1, len(sorted_values))).bit_length() - 1)
    gaps = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    rest = np.empty((len(gaps), shift), np.uint8)
    for k in range(shift):
        rest[:, k] = (gaps >> np.uint64(shift - 1 - k)) & np.uint64(1)
    return bytes([shift]) + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def decode(code: bytes, count: int) -> np.ndarray:
    shift = code[0]
    tail = -(-count * shift // 8)
    data = np.frombuffer(code, np.uint8, offset=1)
    unary = np.flatnonzero(np.unpackbits(data[:len(data) - tail]))[:count]
    gaps = (np.diff(unary, prepend=-1) - 1).astype(np.uint64) << np.uint64(shift)
    rest = np.unpackbits(data[len(data) - tail:], count=count * shift).reshape(count, shift)
    for k in range(shift):
        gaps |= rest[:, k].astype(np.uint64) << np.uint64(shift - 1 - k)
    return np.cumsum(gaps, dtype=np.uint64)
