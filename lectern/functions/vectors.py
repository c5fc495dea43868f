"""Vector arithmetic on arrays of floats with 64-bit sums."""

from __future__ import annotations

from pyspark.sql import functions as F


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a, b):
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a):
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b, norm_a=None, norm_b=None):
    """Cosine of two vectors; 0 where one has no length."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalised(a):
    """A vector scaled to length 1; one without length stays."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: (x / size).cast("float")))


def euclidean(a, b):
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))
