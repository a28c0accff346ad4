"""Expressions over array<double> columns, unrolled so that they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a row costs that a representation stands for: a function of the row, the representation and the number of dimensions.
Distortion = Callable[[Column, Column, int], Column]


def dist(x: Column, r: Column, dims: int) -> Column:
    """Euclidean distance by direct subtraction."""
    return F.sqrt(reduce(lambda a, b: a + b, ((x[i] - r[i]) * (x[i] - r[i]) for i in range(dims))))


def manhattan(x: Column, r: Column, dims: int) -> Column:
    """Sum of absolute differences."""
    return reduce(lambda a, b: a + b, (F.abs(x[i] - r[i]) for i in range(dims)))


def chebyshev(x: Column, r: Column, dims: int) -> Column:
    """The largest absolute difference."""
    return F.greatest(*[F.abs(x[i] - r[i]) for i in range(dims)], F.lit(0.0))


def squared(x: Column, r: Column, dims: int) -> Column:
    """Sum of squared differences."""
    return reduce(lambda a, b: a + b, ((x[i] - r[i]) * (x[i] - r[i]) for i in range(dims)))


def mean(x: Column, dims: int) -> Column:
    """Aggregate: the element-wise mean."""
    return F.array(*[F.avg(x[i]) for i in range(dims)])


def xlog2x(f: Column) -> Column:
    return F.when(f > 0, f * F.log2(f)).otherwise(0.0)


def change_of_entropy(f: Column, n: Column) -> Column:
    """What a row's leaving a cluster of f rows changes in the entropy of n rows; 0 for one-row clusters."""
    return F.when(f > 1, (xlog2x(f) - xlog2x(f - 1)) / n).otherwise(0.0)
