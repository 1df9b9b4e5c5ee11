"""Whole numbers of many rows as bytes of few: what is the same in many of them takes little room in a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def packed(x: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: the whole numbers between each two bounds, their bytes of equal weight together, compressed."""
    x = x.astype(np.int64).view(np.uint64)
    x = x << np.uint64(1) ^ np.where(x >> np.uint64(63), ~np.uint64(0), np.uint64(0))  # small ones of either sign become small
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = [(x >> np.uint64(8 * p)).astype(np.uint8) for p in range(width)]
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        parts = [_CODEC.compress(y, asbytes=True) if (y := p[lo:hi]).any() else b"" for p in planes]
        out.append(np.array([hi - lo, *map(len, parts)], "<u4").tobytes() + b"".join(parts))
    return pa.array([np.uint8(width).tobytes() + y for y in out], pa.binary())


def numbers(row: bytes) -> np.ndarray:
    """What packed() made a row of."""
    n, *sizes = np.frombuffer(row, "<u4", 1 + row[0], 1).tolist()
    x, at = np.zeros(n, np.uint64), 5 + 4 * row[0]
    for p, size in enumerate(sizes):
        if size:
            x |= np.frombuffer(_CODEC.decompress(row[at : at + size], n, asbytes=True), np.uint8).astype(np.uint64) << np.uint64(8 * p)
            at += size
    return (x >> np.uint64(1) ^ np.where(x & np.uint64(1), ~np.uint64(0), np.uint64(0))).view(np.int64)
