"""Vectors as whole numbers; shared by operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Squared distances of up to 64 components below this magnitude fit a BIGINT.
LIMIT = 1 << 27


def whole_vectors(rows: DataFrame, dims: int, keep: list[str], vector: str = "embedding", factor: int = 256) -> DataFrame:
    """``keep`` and ``v``: floor(factor * x) of every component x, for the vectors that have exactly ``dims`` finite components.

    Null vectors and those with null, NaN or infinite components or another length are left out.  A component of
    2**27 or more (after the factor) fails the job: its squared distance has no place in a BIGINT.
    """
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))

    def whole(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * factor)
        return F.when(scaled.between(1 - LIMIT, LIMIT - 1), scaled.cast("int")).otherwise(F.raise_error(F.lit("vector component too large for exact distances")).cast("int"))

    sound = rows.where(x.isNotNull() & (F.size(x) == dims) & finite)
    return sound.select(*[F.col(f"`{c}`") for c in keep], F.transform(x, whole).alias("v"))


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """The rows of a list column without nulls, each of ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    ends = np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))
