"""Cosine similarity as higher-order functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if sizes differ or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def score(a: Column, b: Column, mode: str = "index") -> Column:
    """``index``: (1 + cosine) / 2, as vector indexes report it; ``cosine``: the cosine."""
    c = cosine(a, b)
    return (1 + c) / 2 if mode == "index" else c
