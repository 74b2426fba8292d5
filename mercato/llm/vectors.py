"""Vectors of a table: which rows take part in cosine comparisons, and how cosine is computed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_vectors(rows: DataFrame, *keep: str) -> DataFrame:
    """vec_id, embedding (array<double>) and ``keep`` of the rows whose vector has only finite
    components, not all zero. Null ids and vectors take no part."""
    vector = F.col("embedding").cast("array<double>")

    def broken(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), *keep)
            .filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
            .filter(~F.exists("embedding", broken)).filter(F.exists("embedding", lambda x: x != 0)))


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow or pandas batch, which all have one length, as float64 rows."""
    values = list(column)
    return np.array(values, dtype=np.float64) if values else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tamed(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    wild = (top > 1e100) | (top < 1e-100)
    return np.where(wild, x / top, x) if wild.any() else x


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y in double precision, its sums taken in the
    order of the components. Rows whose squares would leave the range of doubles are scaled."""
    x, y = _tamed(x), _tamed(y)
    dot, xx, yy = (np.zeros(len(x)) for _ in range(3))
    for j in range(x.shape[1]):
        dot += x[:, j] * y[:, j]
        xx += x[:, j] * x[:, j]
        yy += y[:, j] * y[:, j]
    return np.clip(dot / (np.sqrt(xx) * np.sqrt(yy)), -1.0, 1.0)
