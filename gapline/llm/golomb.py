"""Golomb-Rice coding of sorted whole numbers, with array operations only.

A gap is written as gap >> k in unary and its k low bits as they are. Both parts have their own
run of bits, so neither coding nor decoding needs a loop over the numbers.
"""

from __future__ import annotations

import numpy as np

HEAD = np.dtype([("n", "<u4"), ("k", "<u4"), ("unary", "<u4")])


def encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit numbers as bytes."""
    n = len(values)
    head = np.zeros(1, HEAD)
    head["n"] = n
    if not n:
        return head.tobytes()
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(values[-1]) // n).bit_length()
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients) + np.arange(n)] = 0          # a zero ends each quotient
    low = gaps & np.uint64((1 << k) - 1)
    bits = np.empty((n, k), np.uint8)
    for b in range(k):
        bits[:, b] = (low >> np.uint64(k - 1 - b)) & np.uint64(1)
    head["k"], head["unary"] = k, len(unary)
    return head.tobytes() + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def decode(data: bytes) -> np.ndarray:
    head = np.frombuffer(data, HEAD, 1)
    n, k, size = (int(head[c][0]) for c in ("n", "k", "unary"))
    if not n:
        return np.zeros(0, np.uint64)
    at = HEAD.itemsize
    taken = (size + 7) // 8
    unary = np.unpackbits(np.frombuffer(data, np.uint8, taken, at), count=size)
    ends = np.flatnonzero(unary == 0)
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + taken), count=n * k)
        bits = bits.reshape(n, k)
        for b in range(k):
            gaps |= bits[:, b].astype(np.uint64) << np.uint64(k - 1 - b)
    return np.cumsum(gaps, dtype=np.uint64)
