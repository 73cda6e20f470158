"""Small numpy kernels on flattened lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Well-spread 64-bit hash of integers, as uint64."""
    with np.errstate(over="ignore"):
        z = x.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row within the slice, value) of a list column, in slices of about `most` values; null values are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        part = column.slice(first, stop - first)
        rows, values = pc.list_parent_indices(part), pc.list_flatten(part)
        if values.null_count:
            there = pc.is_valid(values)
            rows, values = rows.filter(there), values.filter(there)
        yield first, rows.to_numpy(zero_copy_only=False).astype(np.int64), values.to_numpy(zero_copy_only=False).astype(np.int64)
        first = stop


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each run of the given lengths."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
