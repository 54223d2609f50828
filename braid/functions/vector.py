"""Distances between an array column and a query vector. All sort ascending."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from braid.config import METRICS


def checked(vector) -> list[float]:
    out = []
    for i, x in enumerate(vector):
        if isinstance(x, bool) or not isinstance(x, (int, float)) and not hasattr(x, "__float__") or not math.isfinite(float(x)):
            raise ValueError(f"embedding element {i} isn't a finite number")
        out.append(float(x))
    if not out:
        raise ValueError("the embedding is empty")
    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def distance(column: str | Column, query: Column, metric: str) -> Column:
    """Distance of two array<double> expressions; null if their lengths differ, NaN for a zero vector under cosine."""
    a = F.transform(F.col(column) if isinstance(column, str) else column, lambda x: x.cast("double"))
    kind = METRICS[metric]
    if kind == "l2":
        d = F.sqrt(_sum(F.zip_with(a, query, lambda x, y: (x - y) * (x - y))))
    elif kind == "l1":
        d = _sum(F.zip_with(a, query, lambda x, y: F.abs(x - y)))
    elif kind == "inner_product":
        d = -_sum(F.zip_with(a, query, lambda x, y: x * y))
    else:
        norms = _sum(F.transform(a, lambda x: x * x)) * _sum(F.transform(query, lambda x: x * x))
        d = F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - _sum(F.zip_with(a, query, lambda x, y: x * y)) / F.sqrt(F.when(norms == 0, 1.0).otherwise(norms)))
    return F.when(F.size(a) == F.size(query), d)


def literal(vector) -> Column:
    return F.array(*[F.lit(x) for x in checked(vector)])
