"""Vectors of a table as whole numbers, and as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True where a vector is there and all its components are finite numbers."""
    infinite = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole_numbers(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of integers as rows; shorter ones are filled up with zeros to ``width``, or to the longest."""
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, in the fastest numbers that hold them.

    No sum on the way exceeds the product of the largest lengths of two rows.
    """
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))
    x, y = (np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0)) for m in (a, b))
    if x * y < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if x * y < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if x * y < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("scores of such large components don't fit 64 bits")
