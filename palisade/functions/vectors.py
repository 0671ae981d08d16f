"""Vector expressions over ``array<float|double>``, summed left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column, norm_a: Column = None, norm_b: Column = None) -> Column:
    """1 - cosine similarity; norms can be passed in when they were computed once per row."""
    scale = (norm_a if norm_a is not None else norm(a)) * (
        norm_b if norm_b is not None else norm(b)
    )
    return F.lit(1.0) - F.try_divide(dot(a, b), scale)


def vector_problem(vector: Column, dimensions: Column) -> Column:
    """Null for a usable vector, else the reason it cannot be stored."""
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), F.lit("missing_vector"))
        .when(F.size(vector) != dimensions, F.lit("unexpected_dimension"))
        .when(
            F.exists(
                vector,
                lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
            ),
            F.lit("non_finite_value"),
        )
    )
