"""Distances between array columns, as higher-order functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within [0, 2]; 1 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def inner_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS = {"cosine": cosine_distance, "l2": l2_distance, "euclidean": l2_distance, "inner_product": inner_product_distance, "ip": inner_product_distance}


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """By the metric's name; an unknown one counts as cosine."""
    return METRICS.get(metric, cosine_distance)(a, b)
