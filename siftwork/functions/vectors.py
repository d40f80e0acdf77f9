"""Functions on arrays of numbers; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, floor: float = 0.0) -> Column:
    """a / |a|; a zero vector stays zero, or is divided by `floor` if that is positive."""
    size = F.greatest(norm(a), F.lit(floor)) if floor else norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / F.nullif(size, F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """Logistic function, in the form that cannot overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1 + F.exp(-F.abs(x))))


def ema(vectors: Column, alpha: float = 0.9) -> Column:
    """Exponential average of an ordered array of vectors, normalised after each step."""
    step = lambda acc, v: F.when(F.size(acc) == 0, l2_normalize(v)).otherwise(l2_normalize(F.zip_with(acc, l2_normalize(v), lambda a, b: a * alpha + b * (1 - alpha))))
    return F.aggregate(vectors, F.array().cast("array<double>"), step)
