"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column, epsilon: float = 0.0) -> Column:
    """Divided by the norm (plus epsilon); a zero vector stays as it is."""
    n = norm(a) + epsilon
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    n = (norm(a) + epsilon) * (norm(b) + epsilon)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def is_placeholder(a: Column) -> Column:
    """Null, empty or all but zero."""
    return a.isNull() | (F.size(a) == 0) | F.forall(a, lambda x: F.abs(x) < 1e-7)


def summary(a: Column, chunk_vectors: Column | None = None) -> Column:
    """Norm, first three components, whether it is a placeholder, and how many chunk vectors there are."""
    count = F.lit(0) if chunk_vectors is None else F.greatest(F.lit(0), F.coalesce(F.size(chunk_vectors), F.lit(0)))
    return F.struct(norm(a).alias("norm"), F.slice(a, 1, 3).alias("sample"), is_placeholder(a).alias("is_zero"), count.alias("chunk_count"))
