"""What the operators on vectors share: rows that take part, whole-number components, matrices of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-number components are held within ± this bound: beyond it, squared distances of 64 components no longer fit a long.
BOUND = 2**27
#: Sums of products below this size are exact in double precision.
EXACT = 2**53


def usable(vector: str = "embedding") -> Column:
    """True for vectors that are there and hold neither nulls, NaN nor infinities."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """array<int>: floor(scale * x) of each component x as double, held within ±BOUND."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(BOUND)), F.lit(-BOUND)).cast("int"))


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row for each list; short lists are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def lists_of(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as Arrow lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), kind))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with the rows of ``b``; components that one side lacks count as zero."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
