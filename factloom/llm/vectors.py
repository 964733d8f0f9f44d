"""Vector columns as matrices, within one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the places of the vectors with exactly dims entries, none null or non-finite, and those vectors as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(there & (np.diff(offsets) == dims))
    entries = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    matrix = entries[offsets[rows][:, None] + np.arange(dims)] if len(rows) else np.empty((0, dims))
    whole = np.isfinite(matrix).all(axis=1)
    return rows[whole], matrix[whole]


def scaled(matrix: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as int64; an entry beyond `most` is an error, since what is made of it would not fit its type."""
    out = np.floor(scale * matrix)
    if len(out) and np.abs(out).max() > most:
        raise ValueError(f"an entry of a vector is beyond {most} / {scale}")
    return out.astype(np.int64)


def lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, dims = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(np.ascontiguousarray(matrix).reshape(-1)))
