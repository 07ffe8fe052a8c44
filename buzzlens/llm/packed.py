"""Sorted lists of integers as small binary values, for shuffles of many hashes."""

from __future__ import annotations

import numpy as np


def pack_sorted(values: np.ndarray) -> bytes:
    """Differences of an ascending uint64 array, in as many bytes each as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    # One plane per byte: the high planes are nearly constant and compress well.
    return bytes([width]) + raw.T.tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    """The array ``pack_sorted`` was given."""
    if not packed:
        return np.zeros(0, np.uint64)
    width = packed[0]
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1)
    raw = np.zeros((planes.shape[1], 8), np.uint8)
    raw[:, :width] = planes.T
    return np.cumsum(raw.reshape(-1).view("<u8"), dtype=np.uint64)


def found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position in the ascending ``table`` of each value, -1 where it is absent."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)
