"""Split criteria as column expressions, unnormalised: they scale with the weight of a node.

A branch is a list of columns, the weights of its classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(branch: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, branch)


def fast_log2(x: Column) -> Column:
    """log2 in single precision: exponent plus a quadratic of the mantissa in [1, 2)."""
    x = x.cast("float").cast("double")
    e = F.floor(F.log2(x))
    p = F.pow(F.lit(2.0), e)
    e = F.when(x < p, e - 1).when(x >= 2 * p, e + 1).otherwise(e)
    m = (x / F.pow(F.lit(2.0), e)).cast("float")
    third = F.lit(-1.0 / 3).cast("float")
    two = F.lit(2.0).cast("float")
    return ((third * m + two) * m - F.lit(2.0 / 3).cast("float")) + (e - 1).cast("float")


def x_log_x(x: Column) -> Column:
    """x * log2(x), 0 at or below 1e-6."""
    return F.when(x <= 1e-6, F.lit(0.0)).otherwise(x * fast_log2(x).cast("double"))


def entropy_prior(branch: list[Column]) -> Column:
    return x_log_x(total(branch)) - total([x_log_x(c) for c in branch])


def entropy_conditional(branches: list[list[Column]]) -> Column:
    return total([entropy_prior(b) for b in branches])


def gini_prior(branch: list[Column]) -> Column:
    s = total(branch)
    return F.when(s == 0, F.lit(0.0)).otherwise(s - F.try_divide(total([c * c for c in branch]), s))


def gini_conditional(branches: list[list[Column]]) -> Column:
    return total([gini_prior(b) for b in branches])


def proportions(branches: list[Column]) -> list[Column]:
    """Share of each branch's weight; equal shares if all are empty."""
    s = total(branches)
    return [F.coalesce(F.try_divide(b, s), F.lit(1.0 / len(branches))) for b in branches]


def midpoint(a: Column, b: Column) -> Column:
    """Halfway between two floats, in double precision: strictly between them if they differ."""
    return (a.cast("double") + b.cast("double")) / 2
