"""Similarity of float arrays as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def euclidean_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y))))
