"""Column functions on embedding arrays; all arithmetic is in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = F.transform(F.array(norm(vector)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))
    return F.flatten(
        F.transform(length, lambda n: F.transform(as_double(vector), lambda x: x / n))
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_usable(vector: Column) -> Column:
    """Present, and neither empty nor all zero: a vector that has a direction."""
    return F.coalesce(norm(vector) > 0, F.lit(False))
