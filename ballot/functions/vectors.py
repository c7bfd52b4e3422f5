"""Distances as Column expressions, evaluated in the JVM, and the metric names."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(str, Enum):
    """L2: Euclidean, nearest is least. IP: inner product, nearest is greatest, reported as it is."""

    L2 = "l2"
    IP = "ip"

    @classmethod
    def of(cls, value: Metric | str) -> Metric:
        try:
            return cls(value.lower() if isinstance(value, str) and not isinstance(value, Metric) else value)
        except ValueError:
            raise ValueError(f"unknown metric {value!r}; use 'l2' or 'ip'") from None


IP, L2 = Metric.IP, Metric.L2


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_l2(a: Column, b: Column) -> Column:
    def square(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def normalised(a: Column) -> Column:
    """The vector at unit length, as doubles; zero vectors stay. With IP this gives cosine similarity."""
    wide = a.cast("array<double>")
    norm = F.sqrt(inner_product(a, a))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def sort_key(a: Column, b: Column, metric: Metric | str) -> Column:
    """Ascending in nearness: squared distance, or the inner product's negative."""
    return squared_l2(a, b) if Metric.of(metric) is L2 else -inner_product(a, b)


def reported(key: Column, metric: Metric | str) -> Column:
    """What callers see of a sort key: the root of the squared distance, or the product."""
    return F.sqrt(key) if Metric.of(metric) is L2 else -key
