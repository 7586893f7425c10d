"""Which rows of a vector table take part in searches and links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _directed(df: DataFrame, key: str, vector: str) -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(finite & F.exists(vector, lambda x: x != 0))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))


def common_size(df: DataFrame, key: str, vector: str) -> int:
    """The commonest size of vectors that have a direction, the smaller one of two; -1 if there is none."""
    common = _directed(df, key, vector).groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return common["d"] if common else -1


def usable(df: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(id, vec) of rows whose vector has a direction: not null, empty or zero, all parts finite, and of ``size``.

    Without a size it is the commonest. Rows with a null key are left out.
    """
    return _directed(df, key, vector).where(F.size("vec") == (common_size(df, key, vector) if size is None else size))


def matrix(column) -> np.ndarray:
    """A list column of equal sizes as double rows."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; scaled first, so that extreme parts neither overflow nor vanish."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))
