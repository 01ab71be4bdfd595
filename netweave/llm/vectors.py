"""What the operators on embeddings share: which vectors count, and their blocks as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def takes_part(id_col: str = "vec_id", vec_col: str = "embedding") -> Column:
    """Whether a row's vector counts: not null, not zero, no component null or not finite; and the row has an id."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None) -> tuple[DataFrame, int]:
    """``id, v`` of the rows that take part, a row each also where ids or vectors repeat, and the vectors' length.

    See ``takes_part``. Vectors of another length than most (ties: than the shortest of the most frequent lengths) take
    no part either, nor of another than ``dim`` where that is given. The length is 0 if there are none.
    """
    good = table.where(takes_part(id_col, vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    if dim is None:
        most = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        dim = most[0]["n"] if most else 0
    return good.where(F.size("v") == dim), dim


def block_rows(dim: int, budget: int = 32 << 20, most: int = 16_384) -> int:
    """Rows of a block whose matrix of doubles keeps to ``budget`` bytes."""
    return max(64, min(most, budget // (8 * max(dim, 1))))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def dot_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices (or of rows with one vector), summed from the first component on.

    The order of the sum is the same for every pair, so equal vectors get equal products to the last bit.
    """
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[..., j]
    return out
