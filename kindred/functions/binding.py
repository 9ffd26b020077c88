"""Binding a computed value within a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once: within the lambdas of array functions an outer expression is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
