"""Small helpers for building columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for the row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def divided(n: Column, d: Column) -> Column:
    """n / d as IEEE doubles do it: infinities and NaN instead of errors or nulls."""
    n, d = n.cast("double"), d.cast("double")
    at_zero = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))).when(n == 0, F.lit(float("nan")))
    return F.when(d != 0, n / d).otherwise(at_zero)
