"""Vector expressions over arrays of numbers; sums run in double precision, from the first component on."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(x)) for x in values])


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NaN for a vector of length zero; null for null, or vectors of different dimensions."""
    lengths = norm(a) * norm(b)
    value = F.when(lengths == 0, F.lit(float("nan"))).otherwise(inner_product(a, b) / F.when(lengths != 0, lengths))
    return F.when(F.size(a) == F.size(b), value)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)
