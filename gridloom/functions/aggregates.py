"""Aggregates for ``groupBy().agg`` and windows.

A sum of nothing is 0, a product of nothing 1, ``all`` of nothing true, ``any`` false, ``none`` true; other aggregates of
nothing are null. Nulls are skipped but by ``length``, ``first`` and ``last``. Exact forms take a decimal's scale.
Medians, quantiles and exact products and variances, which need more than a running state, are in
``operators.quantiles`` and below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.logic import ColumnOrName, col


def total(x: ColumnOrName, scale: int = 0, digits: int = 28) -> Column:
    """Exact sum of whole numbers or decimals: it is widened, so it does not overflow. ``digits``: what a value has at
    most; up to 18 the values are read as machine words."""
    return F.coalesce(F.sum(col(x).cast(f"decimal({digits},{scale})")), F.lit(0)).cast(f"decimal(38,{scale})")


def total_float(x: ColumnOrName) -> Column:
    """Floats are added in no fixed order, so the last digits may differ between runs."""
    return F.coalesce(F.sum(col(x).cast("double")), F.lit(0.0))


def total_duration(x: ColumnOrName) -> Column:
    return F.sum(col(x))


def mean(x: ColumnOrName, scale: int = 0, digits: int = 17) -> Column:
    """Exact sum over count, rounded half away from zero to ten places or the finer scale."""
    places = max(10, scale)
    s = F.sum(col(x).cast(f"decimal({digits},{scale})")).cast(f"decimal(27,{places})")
    return F.round(F.try_divide(s, F.count(col(x)).cast("decimal(10,0)")), places).cast(f"decimal(38,{places})")


def mean_float(x: ColumnOrName) -> Column:
    return F.avg(col(x).cast("double"))


def minimum(x: ColumnOrName) -> Column:
    return F.min(col(x))


def maximum(x: ColumnOrName) -> Column:
    """NaN is greatest."""
    return F.max(col(x))


def count(x: ColumnOrName) -> Column:
    return F.count(col(x))


def length() -> Column:
    return F.count(F.lit(1))


def first(x: ColumnOrName, order: ColumnOrName) -> Column:
    """The value of the first row, null included."""
    return F.min_by(col(x), col(order))


def last(x: ColumnOrName, order: ColumnOrName) -> Column:
    return F.max_by(col(x), col(order))


def product_float(x: ColumnOrName) -> Column:
    return F.coalesce(F.product(col(x).cast("double")), F.lit(1.0))


def variance(x: ColumnOrName, ddof: int = 1) -> Column:
    """Null where count - ddof is not above 0."""
    x = col(x).cast("double")
    if ddof == 1:
        return F.var_samp(x)
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / F.when(n > ddof, n - ddof))


def std(x: ColumnOrName, ddof: int = 1) -> Column:
    return F.sqrt(variance(x, ddof))


def variance_exact(x: ColumnOrName, scale: int, ddof: int = 1) -> Column:
    """Of decimals, from exact sums of values and squares; ten places."""
    v = col(x).cast(f"decimal(12,{scale})")
    n, s, q = F.count(v), F.sum(v).cast(f"decimal(18,{scale})"), F.sum(v * v).cast(f"decimal(27,{2 * scale})")
    spread = q * n.cast("decimal(10,0)") - s * s
    return F.when(n > ddof, F.round(F.try_divide(spread.cast(f"decimal(27,{2 * scale})"), (n * (n - ddof)).cast("decimal(18,0)")), 10).cast("decimal(38,10)"))


def all_(x: ColumnOrName) -> Column:
    return F.coalesce(F.bool_and(col(x)), F.lit(True))


def any_(x: ColumnOrName) -> Column:
    return F.coalesce(F.bool_or(col(x)), F.lit(False))


def none_(x: ColumnOrName) -> Column:
    return ~any_(x)


# Of the cells of one row, nulls skipped.


def _cells(xs: tuple[ColumnOrName, ...]) -> Column:
    return F.filter(F.array(*map(col, xs)), lambda v: v.isNotNull())


def row_sum(*xs: ColumnOrName, scale: int = 2, digits: int = 28) -> Column:
    """Exact sum of whole numbers or decimals of at most ``scale`` places; a decimal with more is an error."""
    kind = f"decimal(38,{scale})"

    def cell(x: ColumnOrName) -> Column:
        fit = col(x).cast(f"decimal({digits},{scale})")
        return F.when(F.typeof(col(x)).startswith("decimal") & (fit != col(x)), F.raise_error(F.lit(f"row_sum: a value has more than {scale} places"))).otherwise(fit)

    return F.aggregate(_cells(tuple(map(cell, xs))), F.lit(0).cast(kind), lambda a, v: (a + v).cast(kind))


def row_sum_float(*xs: ColumnOrName) -> Column:
    return F.aggregate(_cells(tuple(col(x).cast("double") for x in xs)), F.lit(0.0), lambda a, v: a + v)


def row_min(*xs: ColumnOrName) -> Column:
    return F.array_min(_cells(xs))


def row_max(*xs: ColumnOrName) -> Column:
    return F.array_max(_cells(xs))


def row_count(*xs: ColumnOrName) -> Column:
    return F.size(_cells(xs)).cast("bigint")


def row_mean_float(*xs: ColumnOrName) -> Column:
    return F.try_divide(row_sum_float(*xs), row_count(*xs).cast("double"))


def range_sum(low: Column, high: Column) -> Column:
    """Sum of the whole numbers low..high, in closed form; 0 where there are none."""
    low, high = low.cast("decimal(18,0)"), high.cast("decimal(18,0)")
    both = ((low + high) * (high - low + 1)).cast("decimal(37,0)")
    return F.when(high >= low, (both / F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")).when(low.isNotNull() & high.isNotNull(), F.lit(0).cast("decimal(38,0)"))
