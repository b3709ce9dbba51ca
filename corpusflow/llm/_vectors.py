"""Embeddings as integer vectors: the rows that count, and their matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FINITE = "embedding IS NOT NULL AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))"
_SCALED = "transform(embedding, v -> cast(floor(256 * cast(v AS double)) AS bigint))"
#: Whole numbers below this are exact in float64.
EXACT = 1 << 53


def integer_vectors(rows: DataFrame, *keep) -> DataFrame:
    """keep and x array<long>, floor(256 * entry), of the rows whose embedding and all its entries are given and finite."""
    return rows.where(_FINITE).select(*keep, F.expr(_SCALED).alias("x"))


def matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows of int64, with zeros up to the longest vector or to width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int64)
    lens = np.diff(offsets)
    width = max(width, int(lens.max(initial=0)))
    if (lens == width).all():
        return values.reshape(len(lens), width)
    out = np.zeros((len(lens), width), np.int64)
    out[np.arange(width) < lens[:, None]] = values
    return out


def largest(x: np.ndarray) -> int:
    """Largest absolute value, as a Python integer."""
    return max(int(x.max()), -int(x.min())) if x.size else 0
