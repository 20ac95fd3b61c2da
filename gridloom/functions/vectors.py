"""Vectors held as values: list literals, ranges, element-wise arithmetic, positions, slices and sorts, over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.logic import ColumnOrName, col


def vector(*values: object) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def whole_range(low: Column, high: Column, without_low: bool = False, without_high: bool = False) -> Column:
    """``low..high``; empty where the start is past the end."""
    first, last = low + 1 if without_low else low, high - 1 if without_high else high
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.slice(F.sequence(first, first), 1, 0))


def each(v: ColumnOrName, f: Callable[[Column], Column]) -> Column:
    """``v * 2``: a function of every element."""
    return F.transform(col(v), f)


def both(a: ColumnOrName, b: ColumnOrName, f: Callable[[Column, Column], Column]) -> Column:
    """``v + w``: element by element; vectors of different lengths are an error."""
    a, b = col(a), col(b)
    same = F.when(a.isNull() | b.isNull(), F.lit(True)).otherwise(F.size(a) == F.size(b))
    return F.when(F.assert_true(same, "vectors of different lengths").isNull(), F.zip_with(a, b, f))


def at(v: ColumnOrName, position: int) -> Column:
    """From 0; negative positions count from the end; past the ends is an error."""
    return F.element_at(col(v), position + 1 if position >= 0 else position)


def between(v: ColumnOrName, low: int, high: int) -> Column:
    """``v[low..high]``, clamped."""
    return F.slice(col(v), low + 1, high - low + 1)


def sort(v: ColumnOrName, desc: bool = False) -> Column:
    """Nulls first ascending and last descending."""
    return F.sort_array(col(v), asc=not desc)


def head(v: ColumnOrName, n: int) -> Column:
    return F.slice(col(v), 1, n)


def tail(v: ColumnOrName, n: int) -> Column:
    return F.slice(col(v), -F.least(F.size(col(v)), F.lit(n)), F.least(F.size(col(v)), F.lit(n)))


def total(v: ColumnOrName) -> Column:
    """Nulls skipped; of nothing 0."""
    return F.aggregate(F.filter(col(v), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)


def length(v: ColumnOrName) -> Column:
    return F.size(col(v)).cast("bigint")


def count(v: ColumnOrName) -> Column:
    return F.size(F.filter(col(v), lambda x: x.isNotNull())).cast("bigint")
