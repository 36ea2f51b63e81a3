"""Arrays of numbers as compressed cells, for steps that shuffle many small numbers."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Numbers of up to 64 bits as eight byte planes behind each other, compressed; planes of zeros take next to nothing."""
    v = np.ascontiguousarray(values.astype("<u8"))
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return pack(np.diff(values.astype("<u8"), prepend=np.uint64(0)))


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def spans(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal rows in the sorted columns."""
    n = len(keys[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    differ = np.zeros(n - 1, bool)
    for k in keys:
        differ |= k[1:] != k[:-1]
    begins = np.flatnonzero(np.append(True, differ))
    return begins, np.append(begins[1:], n)


def group_sums(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of each column by key; exact for whole numbers."""
    if not len(keys):
        return keys, *columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first, _ = spans(keys)
    return keys[first], *(np.add.reduceat(c[order], first) for c in columns)
