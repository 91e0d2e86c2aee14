"""What the operators on vectors share: rows whose components are whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Squared lengths stay below this, so that 64-bit integers hold every inner product and every squared distance.
LARGEST = float(1 << 60)


def floors(vec: Column) -> Column:
    """Each component x as floor(256 * x), x taken as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256))


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, **others: Column) -> DataFrame:
    """Rows ``(id, *others, q)`` with ``q`` the floors of the vector's components.

    Rows with a null vector, or with a null, NaN or infinite component, are
    dropped; so are vectors whose squared length in floors reaches ``LARGEST``.
    Empty vectors stay. Other columns of ``df`` are ignored.
    """
    vec = F.col(vec_col)
    length = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + F.pow(F.coalesce(x.cast("double"), F.lit(float("inf"))) * 256, 2))
    # NaN is larger than every number
    fit = df.where(vec.isNotNull() & (length < LARGEST))
    return fit.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in others.items()], floors(vec).alias("q"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None, dtype: type = np.int64) -> np.ndarray:
    """Lists of numbers as the rows of a matrix; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = width if width is not None else int(lengths.max(initial=0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, exact: in floating point only where that holds every partial sum."""
    a_max, b_max = (int(np.abs(x).max(initial=0)) for x in (a, b))
    if a_max * b_max * max(1, a.shape[1]) < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of ``a`` to all of ``b``, exact."""
    return (a * a).sum(1)[:, None] - 2 * products(a, b) + (b * b).sum(1)[None, :]
