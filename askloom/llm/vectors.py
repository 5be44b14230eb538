"""Vectors as packed rows of doubles, and which of them can be compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or a non-finite component."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(fine, F.lit(False))


def one_per_id(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, column``: one row per id, the smallest vector of those that share it; null ids are left out."""
    ids = vectors.select(F.col(key).cast("bigint").alias(key), column).where(F.col(key).isNotNull())
    return ids.groupBy(key).agg(F.min(column).alias(column))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; vectors shorter than ``dim`` are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def largest_size(vectors: DataFrame, column: str = "embedding") -> tuple[int, int]:
    """Number of rows and the length of the longest vector."""
    row = vectors.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])
