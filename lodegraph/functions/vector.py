"""Distances between float arrays, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance, as a plain expression."""
    d = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column) -> Column:
    """The cosine of unit vectors from their distance."""
    return F.lit(1.0) - F.pow(distance, F.lit(2.0)) / 2


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def l2_to(query: list[float]):
    """Distance of each vector of a column to one vector, in Arrow batches."""
    q = np.asarray(query, np.float64)

    @F.arrow_udf("double")
    def distance(v: pa.Array) -> pa.Array:
        m = matrix(v)
        return pa.array(np.sqrt(((m - q) ** 2).sum(axis=1)) if len(m) else np.zeros(0))

    return distance
