"""Distances and similarities of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    norm = F.sqrt(_sum(_product(a, a))) * F.sqrt(_sum(_product(b, b)))
    return 1 - _sum(_product(a, b)) / F.when(norm != 0, norm)


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    return {"l2sq": squared_l2, "cosine": cosine_distance}[metric](a, b)


def similarity(dist: Column) -> Column:
    """One less the distance, to three places, half to even. What rounds to nothing keeps its sign, as in SQL."""
    rounded = F.bround(1 - dist, 3)
    return F.when((rounded == 0) & (1 - dist < 0), F.lit(-0.0)).otherwise(rounded)
