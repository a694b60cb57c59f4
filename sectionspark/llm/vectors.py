"""Shared steps of the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that aren't zero."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(wide, lambda x: x != 0), F.lit(False))


def one_per_id(table: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Repeated ids count as one vector: the smallest row, in the order of the columns."""
    least = table.groupBy(id_col).agg(F.min(F.struct(*columns)).alias("_row"))
    return least.select(id_col, *(F.col("_row")[c].alias(c) for c in columns))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as float64 rows, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and (lengths == lengths[0]).all():
        return flat.reshape(n, lengths[0])
    out = np.zeros((n, int(lengths.max()) if n else 0))
    for i, (at, size) in enumerate(zip(np.cumsum(lengths) - lengths, lengths)):
        out[i, :size] = flat[at : at + size]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)
