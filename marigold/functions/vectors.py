"""Vector arithmetic on array columns, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """dot / (|a| |b| + epsilon): a zero vector scores 0."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def unit(a: Column, epsilon: float = 1e-12) -> Column:
    n = norm(a) + F.lit(epsilon)
    return F.transform(a, lambda x: x.cast("double") / n)


def sanitized(a: Column, dimension: Column | int) -> Column:
    """`dimension` components: padded by zeros or cut, nulls and non-finite values as 0."""
    d = F.lit(dimension) if isinstance(dimension, int) else dimension

    def component(i: Column) -> Column:
        x = F.get(a, i).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

    return F.transform(F.sequence(F.lit(0), d.cast("int") - 1), component)


def mean_vector(vector: Column, dimension: int) -> Column:
    """Aggregate: the mean of each component over a group."""
    return F.array(*(F.avg(vector[i].cast("double")) for i in range(dimension)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
