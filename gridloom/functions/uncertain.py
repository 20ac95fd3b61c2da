"""Measurements as ``struct<value:double, sigma:double>``: first-order propagation, operands independent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.arithmetic import divide
from gridloom.functions.logic import ColumnOrName, col, let


def measured(value: ColumnOrName, sigma: ColumnOrName) -> Column:
    """``value ± sigma``."""
    made = lambda v, s: F.when(v.isNotNull() & s.isNotNull(), F.struct(v.alias("value"), s.alias("sigma")))
    return let(made, col(value).cast("double"), col(sigma).cast("double"))


def certain(x: ColumnOrName) -> Column:
    return measured(col(x), F.lit(0.0))


def value(x: Column) -> Column:
    return x["value"]


def sigma(x: Column) -> Column:
    return x["sigma"]


def plus(a: Column, b: Column) -> Column:
    return measured(value(a) + value(b), F.hypot(sigma(a), sigma(b)))


def minus(a: Column, b: Column) -> Column:
    return measured(value(a) - value(b), F.hypot(sigma(a), sigma(b)))


def times(a: Column, b: Column) -> Column:
    return measured(value(a) * value(b), F.hypot(value(b) * sigma(a), value(a) * sigma(b)))


def over(a: Column, b: Column) -> Column:
    q = divide(value(a), value(b))
    return measured(q, F.hypot(divide(sigma(a), value(b)), divide(q * sigma(b), value(b))))


def power(a: Column, n: float) -> Column:
    return measured(F.pow(value(a), F.lit(float(n))), F.abs(n * F.pow(value(a), F.lit(n - 1.0))) * sigma(a))


def through(a: Column, f: Column, slope: Column) -> Column:
    """Any function of the value, with its derivative there."""
    return measured(f, F.abs(slope) * sigma(a))


def sqrt(a: Column) -> Column:
    return through(a, F.sqrt(value(a)), divide(F.lit(0.5), F.sqrt(value(a))))


def exp(a: Column) -> Column:
    return through(a, F.exp(value(a)), F.exp(value(a)))


def ln(a: Column) -> Column:
    return through(a, F.ln(value(a)), divide(F.lit(1.0), value(a)))


def sin(a: Column) -> Column:
    return through(a, F.sin(value(a)), F.cos(value(a)))


def cos(a: Column) -> Column:
    return through(a, F.cos(value(a)), F.sin(value(a)))


def tan(a: Column) -> Column:
    return through(a, F.tan(value(a)), 1 + F.tan(value(a)) * F.tan(value(a)))


def absolute(a: Column) -> Column:
    return measured(F.abs(value(a)), sigma(a))


def total(a: Column) -> Column:
    """Aggregate: the sum, its sigma in quadrature."""
    return F.struct(F.coalesce(F.sum(value(a)), F.lit(0.0)).alias("value"), F.sqrt(F.coalesce(F.sum(sigma(a) * sigma(a)), F.lit(0.0))).alias("sigma"))


def mean(a: Column) -> Column:
    """Aggregate: the mean, with the sum's sigma over the count."""
    n = F.count(value(a))
    return F.when(n > 0, F.struct(F.avg(value(a)).alias("value"), F.try_divide(F.sqrt(F.sum(sigma(a) * sigma(a))), n.cast("double")).alias("sigma")))


def minimum(a: Column) -> Column:
    """Aggregate: the measurement with the least value."""
    return F.min_by(a, value(a))


def maximum(a: Column) -> Column:
    return F.max_by(a, value(a))


def equal(a: Column, b: Column) -> Column:
    """The values differ by no more than both sigmas together."""
    return F.abs(value(a) - value(b)) <= sigma(a) + sigma(b)


def less(a: Column, b: Column) -> Column:
    """By the values alone."""
    return value(a) < value(b)
