"""Expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def normalised(v: Column) -> Column:
    """v divided by its sum; unchanged if that is 0."""
    s = vector_sum(v)
    return F.when(s == 0, v).otherwise(F.transform(v, lambda x: F.try_divide(x, s)))


def argmax(v: Column) -> Column:
    """Index of the first greatest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def classified(v: Column) -> Column:
    """argmax of class weights; null if none is positive."""
    return F.when(F.array_max(v) > 0, argmax(v))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def nearly_equal(a: Column, b: Column, within: float = 1e-5) -> Column:
    return F.abs(a - b) < within


def is_pure(weights: list[Column]) -> Column:
    """Whether at most one class has weight (1e-5 or more)."""
    from functools import reduce

    present = reduce(lambda a, b: a + b, [F.when(w >= 1e-5, 1).otherwise(0) for w in weights])
    return present <= 1
