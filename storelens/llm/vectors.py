"""Vectors in Arrow batches: which rows are usable, as one matrix for each length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(usable, starts, lengths, values): values as doubles, null ones as NaN.

    A vector is usable unless it is null or holds a null or non-finite entry; an empty one is.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    good = (bad[starts + lengths] == bad[starts]) & pc.is_valid(column).to_numpy(zero_copy_only=False)
    return good, starts, lengths, values


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of a usable vector, by rising length."""
    good, starts, lengths, values = usable(column)
    for n in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == n))
        yield rows, values[starts[rows][:, None] + np.arange(n)]


def on_grid(values: np.ndarray, scale: float, limit: float) -> np.ndarray:
    """floor(scale * value) as integers, held within ``limit`` on both sides."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -limit, limit).astype(np.int64)


def list_column(rows: np.ndarray, size: int, matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of ``matrix`` at ``rows`` of a column of ``size`` lists, null elsewhere; ``rows`` must rise. NaN is null."""
    lengths = np.zeros(size, np.int64)
    lengths[rows] = matrix.shape[1]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    missing = np.ones(size, bool)
    missing[rows] = False
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind, from_pandas=True), mask=pa.array(missing))
