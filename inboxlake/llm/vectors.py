"""Helpers of the operators on embedding vectors: finite rows as integers, Arrow columns as matrices, packed results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor a non-finite component (an empty one holds none)."""
    # comparisons with NaN: Spark sorts it above infinity, so one bound on each side is enough
    bad = F.exists(vector, lambda c: c.isNull() | ~(c.cast("double") > float("-inf"))
                   | ~(c.cast("double") < float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """Components floor(scale * x) as longs, x as double; beyond 64 bits the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros to ``dims`` (the longest)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dims or 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if dims is None else dims
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer matrices as int64; beyond 64 bits the nearest long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] != b.shape[1]:
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    largest = lambda x: max(abs(int(x.min())), abs(int(x.max())))
    if largest(a) * largest(b) * a.shape[1] < 1 << 53:  # every partial sum is an exact double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)
