"""Vector expressions on array columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col

NORM_EPSILON = 1e-9


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """v / (|v| + 1e-9); the norm is taken once per row."""
    n = F.array(norm(v) + NORM_EPSILON)
    return F.transform(n, lambda s: F.transform(_col(v), lambda x: x.cast("double") / s))[0]


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / ((norm(a) + NORM_EPSILON) * (norm(b) + NORM_EPSILON))
