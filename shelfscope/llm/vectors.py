"""Rows of an embedding table as whole-number vectors: shared by the vector operators.

A component x becomes floor(256 * x), x as double. Rows whose vector is null, or holds
a null, NaN or infinite component, take no part. Products and squares are computed in
64-bit arithmetic; components too large for that raise a ``ValueError``, so a result is
either exact or absent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def vector_rows(df: DataFrame, *more: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``vector`` of the usable rows; ``more`` are further columns."""
    return (df.where(usable(F.col(f"`{vector}`")))
            .select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), *more))


def whole(column: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors of an Arrow column, all of length ``dim``, as rows of whole numbers."""
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    most = float(np.abs(x).max(initial=0))
    if dim * most * most >= 2.0 ** 53 or (dim * most) ** 2 >= 2.0 ** 62:
        raise ValueError(f"components up to {most:.0f} in {dim} places don't fit exact 64-bit products")
    return x.astype(np.int64).reshape(-1, dim)
