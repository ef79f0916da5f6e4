"""Vector kernels over array columns, in double precision and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_ZERO = 0.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(_ZERO), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(_ZERO), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(_ZERO), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, 0.0).otherwise(dot(a, b) / n))
