"""Similarities of double arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_of(product: Column, size_a: Column, size_b: Column) -> Column:
    """From a dot product and two norms; 0 if a side is (nearly) zero."""
    return F.when((size_a < EPS) | (size_b < EPS), 0.0).otherwise(F.try_divide(product, size_a * size_b))


def cosine(a: Column, b: Column) -> Column:
    return cosine_of(dot(a, b), norm(a), norm(b))


def euclidean(a: Column, b: Column) -> Column:
    """exp of the distance over the root of the dimension."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.exp(-F.sqrt(squares) / (F.sqrt(F.size(a).cast("double")) + EPS))
