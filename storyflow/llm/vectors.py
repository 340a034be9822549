"""Vectors as integers: which rows take part, and the numpy views of Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no null, NaN or infinite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def largest(dims: int) -> int:
    """The largest size of a component at which a squared distance of ``dims`` differences fits a long."""
    return math.isqrt((2**63 - 1) // max(1, dims)) // 2


def scaled(vector: Column, scale: int, most: int) -> Column:
    """``floor(scale * x)`` of every component as array<int>; one beyond ``most`` is an error, as sums would not be exact."""

    def one(x: Column) -> Column:
        whole = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < most, whole).otherwise(F.raise_error(F.lit(f"a vector's component is {most} or more in size after scaling"))).cast("int")

    return F.transform(vector, one)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column of integers as rows of int64, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``.

    Where every partial sum is below 2**53 floats hold it exactly, and their
    multiplication is the fast one.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
