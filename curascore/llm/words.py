"""Words and hashes of many texts at once, in numpy: helpers for the operators that work on Arrow batches.

Texts of a batch are cut into chunks of bounded bytes and handled as one byte array each, so memory does not grow
with the batch; a text longer than the bound is a chunk of its own and is always handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def lowered() -> np.ndarray:
    """Byte table that turns A-Z into a-z and leaves all else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def blank_separated() -> np.ndarray:
    """Bytes of words that are separated by the space and by \\x09-\\x0D."""
    table = np.ones(256, bool)
    table[[32, *range(9, 14)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Bytes of words made of a-z, 0-9 and everything beyond ASCII (after lower-casing)."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        made = []
        for step in (_BASE, _INVERSE):
            table = np.full(size, step, np.uint64)
            table[0] = 1
            made.append(np.cumprod(table, dtype=np.uint64))
        _POWERS = made[0], made[1]
    return _POWERS[0][:n], _POWERS[1][:n]


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` with at most ``limit`` bytes, or one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts: ``starts`` and ``ends`` in ``data``, their ``hashes``, and ``bounds`` so that the
    words of text i are ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, texts: list[bytes], member: np.ndarray, fold: np.ndarray | None = None):
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if fold is not None:
            self.data = fold[self.data]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = member[self.data]
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        self.bounds = np.searchsorted(self.starts, self.offsets)

    @property
    def hashes(self) -> np.ndarray:
        return self.prefix_hashes()[0]

    def prefix_hashes(self, *sizes: int) -> list[np.ndarray]:
        """Hashes of the words, then of their first ``sizes`` bytes."""
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * power[:-1], out=total[1:])
        made = []
        for ends in (self.ends, *(np.minimum(self.ends, self.starts + k) for k in sizes)):
            made.append(mix((total[ends] - total[self.starts]) * inverse[self.starts] + (ends - self.starts).astype(np.uint64)))
        return made


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each stretch of ``size`` consecutive values, one for each start that has so many after it."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        total *= _BASE
        total += hashes[k : k + n]
    return mix(total)
