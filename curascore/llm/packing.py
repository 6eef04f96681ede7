"""Integers as compressed bytes, for what tasks send each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", 1)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned integers as compressed byte planes; ``ascending`` ones as differences."""
    v = np.asarray(values, np.uint64)
    if ascending and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    planes = v.view(np.uint8).reshape(-1, 8).T
    used = max((i + 1 for i in range(8) if planes[i].any()), default=0)
    body = np.ascontiguousarray(planes[:used]).tobytes()
    return len(v).to_bytes(7, "little") + bytes([used]) + (_ZSTD.compress(body, asbytes=True) if body else b"")


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    n, used = int.from_bytes(data[:7], "little"), data[7]
    planes = np.zeros((8, n), np.uint8)
    if n and used:
        planes[:used] = np.frombuffer(_ZSTD.decompress(data[8:], n * used, asbytes=True), np.uint8).reshape(used, n)
    v = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
    return np.cumsum(v, dtype=np.uint64) if ascending else v
