"""Vector arithmetic on array columns, in double precision and without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import held


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; null if it has no direction."""
    return F.when(norm(v) > 0, held(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double vectors; 0 if the lengths differ or one has no direction."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity_l2(distance: Column) -> Column:
    return 1 / (1 + distance)
