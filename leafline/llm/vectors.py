"""Vectors in blocks, shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and of finite components only."""
    values = vector.cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(values, lambda x: x != 0), F.lit(False))


def one_zero(vector: Column) -> Column:
    """``vector`` as doubles with zeros of either sign alike, so that equal vectors have equal hashes."""
    return F.transform(vector.cast("array<double>"), lambda x: x + F.lit(0.0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def units(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; components of any size neither overflow nor vanish."""
    scaled = values / np.abs(values).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def by_dimension(column: pa.Array):
    """The rows of each length in a list column, and their matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, matrix(column.take(pa.array(rows)), int(dim))
