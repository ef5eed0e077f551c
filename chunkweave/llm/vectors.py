"""Vectors out of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors as a double matrix, for each length of vectors.

    Left out: vectors that are null, empty or zero, or hold a null, a NaN or an infinity.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    values = column.flatten()
    flat = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        matrix = flat[(ends[rows] - n)[:, None] + np.arange(n)]
        fine = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        if fine.any():
            yield rows[fine], matrix[fine]


def unit(matrix: np.ndarray) -> np.ndarray:
    """The directions of vectors whose squares may be out of range."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
