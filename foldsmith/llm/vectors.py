"""Embedding columns as numpy matrices, and which of their rows can be used."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """The vector is there and all its components are finite numbers; an empty vector is usable."""

    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    numbers = F.col(vector).cast("array<double>")
    return F.coalesce(~F.exists(numbers, odd), F.lit(False))


def width(rows: DataFrame, vector: str) -> int:
    """Length of the longest vector, 0 for an empty table."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row per vector; shorter vectors are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), sizes)
    first = np.cumsum(sizes) - sizes
    out[rows, np.arange(len(flat)) - np.repeat(first, sizes)] = flat
    return out


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as one list<double> column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))
