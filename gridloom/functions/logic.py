"""Comparison, logic and missing values.

A missing value gives a missing answer, but for Kleene ``and``/``or``, the tests ``is_null``/``is_not_null`` and
``fill_null``. ``==``, ``<`` and kin, ``&``, ``|`` and ``~`` are Spark's own: NaN is greatest and equal to itself there too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(f: Callable[..., Column], *values: Column) -> Column:
    """``f(*values)`` with each value worked out once: a value that f reads several times is not repeated in the plan, so
    nested calls stay as long as they are written."""
    row = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(row), lambda r: f(*[r[f"v{i}"] for i in range(len(values))]))[0]


def if_else(condition: Column, then: Column, otherwise: Column) -> Column:
    """Null where the condition is."""
    return F.when(condition, then).when(~condition, otherwise)


def fill_null(x: ColumnOrName, default: Column) -> Column:
    return F.coalesce(col(x), default)


def is_in(x: ColumnOrName, values: list) -> Column:
    """Null of null only: nulls in the list count for nothing."""
    known = [v for v in values if v is not None]
    return col(x).isin(known) if known else F.when(col(x).isNotNull(), F.lit(False))


def in_range(x: ColumnOrName, low: object, high: object, without_low: bool = False, without_high: bool = False) -> Column:
    """``low..high``; the flags are ``^..`` and ``..^``."""
    x = col(x)
    return (x > low if without_low else x >= low) & (x < high if without_high else x <= high)


def chained(*terms: Column) -> Column:
    """``a < b < c``: each neighbour pair in turn."""
    return reduce(lambda p, q: p & q, [x < y for x, y in zip(terms, terms[1:], strict=False)])


def xor(a: Column, b: Column) -> Column:
    return (a | b) & ~(a & b)


def nand(a: Column, b: Column) -> Column:
    """Null if either side is."""
    return F.when(a.isNotNull() & b.isNotNull(), ~(a & b))


def nor(a: Column, b: Column) -> Column:
    return ~(a | b)


def is_null(x: ColumnOrName) -> Column:
    return col(x).isNull()


def is_not_null(x: ColumnOrName) -> Column:
    return col(x).isNotNull()


def is_nan(x: ColumnOrName) -> Column:
    return F.when(col(x).isNotNull(), F.isnan(col(x).cast("double")))


def is_not_nan(x: ColumnOrName) -> Column:
    return ~is_nan(x)


def is_finite(x: ColumnOrName) -> Column:
    x = col(x).cast("double")
    return ~F.isnan(x) & (F.abs(x) != float("inf")) & F.when(x.isNotNull(), F.lit(True))


def is_infinite(x: ColumnOrName) -> Column:
    x = col(x).cast("double")
    return F.abs(x) == float("inf")


def approximately(a: ColumnOrName, b: ColumnOrName, tolerance: float = 1e-15) -> Column:
    """``=~=`` of floats: within ``tolerance`` of the larger, or of zero where one side is zero; false for NaN."""
    a, b = col(a).cast("double"), col(b).cast("double")
    bound = F.when((a == 0) | (b == 0), F.lit(tolerance)).otherwise(F.greatest(F.abs(a), F.abs(b)) * tolerance)
    nan = F.isnan(a) | F.isnan(b)
    return F.when(a.isNotNull() & b.isNotNull(), ~nan & ((a == b) | (F.abs(a - b) < bound)))
