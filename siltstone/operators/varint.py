"""Whole arrays of numbers as bytes of seven bits each, small numbers in one byte."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values (uint64) -> their bytes, and where in these the stretches start that end before values[cuts[k + 1]]."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        low = (values[own] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[ends[own] + k] = low | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return out, ends[cuts]


def decode(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    start = np.concatenate([[0], last[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (shift * 7).astype(np.uint64), start).astype(np.int64)


def running(deltas: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums from the start of each stretch on; lengths: of the stretches, zero ones included."""
    total = np.cumsum(deltas)
    start = np.cumsum(lengths) - lengths
    before = np.where(start > 0, total[np.maximum(start, 1) - 1] if len(total) else 0, 0)
    return total - np.repeat(before, lengths)


def differences(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value less the one before it; those at places `first` stay as they are."""
    out = np.diff(values, prepend=values[:1])
    out[first] = values[first]
    return out
