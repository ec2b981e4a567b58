"""Vector arithmetic on array<float|double> columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import as_column


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def dot(left, right) -> Column:
    return _total(F.zip_with(as_column(left), as_column(right), lambda x, y: x.cast("double") * y.cast("double")))


def norm(value) -> Column:
    return F.sqrt(_total(F.transform(as_column(value), lambda x: x.cast("double") * x.cast("double"))))


def cosine(left, right) -> Column:
    return F.try_divide(dot(left, right), norm(left) * norm(right))


def l2(left, right) -> Column:
    return F.sqrt(
        _total(
            F.zip_with(
                as_column(left),
                as_column(right),
                lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
            )
        )
    )


def scale(value, factor) -> Column:
    by = factor if isinstance(factor, Column) else F.lit(factor)
    return F.transform(as_column(value), lambda x: x.cast("double") * by)


def vector_dim(df: DataFrame, vector: str = "vector") -> int:
    """The one length of a vector column; raises when lengths differ."""
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors of different lengths: {low} .. {high}")
    return int(low or 0)


def sum_vectors(vector: str, dim: int, weight: Column | None = None) -> Column:
    """Element-wise sum as one aggregate Column: adds up map-side, no explode."""
    parts = [F.col(vector)[i].cast("double") for i in range(dim)]
    return F.array(*[F.sum(p if weight is None else p * weight) for p in parts])


def center_and_normalize(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Subtract the mean vector of the table, then scale every row to unit length."""
    dim = vector_dim(df, vector)
    mean = df.agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dim)]).alias("_mean"))
    centred = (
        df.withColumn("_mean", mean.scalar())
        .withColumn(vector, F.zip_with(F.col(vector), F.col("_mean"), lambda x, m: x.cast("double") - m))
        .drop("_mean")
    )
    return centred.withColumn(vector, F.transform(vector, lambda x: x / norm(vector)))


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
