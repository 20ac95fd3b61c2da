"""Complex numbers as ``struct<re:double, im:double>``: principal values, branch cuts as in C99."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.arithmetic import divide
from gridloom.functions.logic import ColumnOrName, col, let


def _bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """The function of complex columns, which reads each of them once."""

    @wraps(f)
    def call(*zs: Column) -> Column:
        return let(f, *zs)

    return call


def complex_(re: Column, im: Column) -> Column:
    return F.when(re.isNotNull() & im.isNotNull(), F.struct(re.cast("double").alias("re"), im.cast("double").alias("im")))


def real(x: ColumnOrName) -> Column:
    return complex_(col(x), F.lit(0.0))


def re(z: Column) -> Column:
    return z["re"]


def im(z: Column) -> Column:
    return z["im"]


def conj(z: Column) -> Column:
    return complex_(re(z), -im(z))


def arg(z: Column) -> Column:
    return F.atan2(im(z), re(z))


def magnitude(z: Column) -> Column:
    return F.hypot(re(z), im(z))


@_bound
def plus(a: Column, b: Column) -> Column:
    return complex_(re(a) + re(b), im(a) + im(b))


@_bound
def minus(a: Column, b: Column) -> Column:
    return complex_(re(a) - re(b), im(a) - im(b))


@_bound
def times(a: Column, b: Column) -> Column:
    return complex_(re(a) * re(b) - im(a) * im(b), re(a) * im(b) + im(a) * re(b))


@_bound
def over(a: Column, b: Column) -> Column:
    d = re(b) * re(b) + im(b) * im(b)
    return complex_(divide(re(a) * re(b) + im(a) * im(b), d), divide(im(a) * re(b) - re(a) * im(b), d))


def power(z: Column, n: int) -> Column:
    """A whole power by repeated products."""
    if n == 0:
        return complex_(F.lit(1.0), F.lit(0.0))
    product = reduce(times, [z] * abs(n))
    return product if n > 0 else over(complex_(F.lit(1.0), F.lit(0.0)), product)


@_bound
def exp(z: Column) -> Column:
    r = F.exp(re(z))
    return complex_(r * F.cos(im(z)), r * F.sin(im(z)))


@_bound
def ln(z: Column) -> Column:
    m = magnitude(z)
    return complex_(F.when(m == 0, float("-inf")).otherwise(F.ln(m)), arg(z))


def _scaled(z: Column, by: float) -> Column:
    return complex_(re(z) / F.lit(by), im(z) / F.lit(by))


def log10(z: Column) -> Column:
    return _scaled(ln(z), 2.302585092994046)


def log2(z: Column) -> Column:
    return _scaled(ln(z), 0.6931471805599453)


@_bound
def sqrt(z: Column) -> Column:
    m = magnitude(z)
    up = F.sqrt((m + F.abs(re(z))) / 2)
    side = F.when(up == 0, 0.0).otherwise(F.try_divide(F.abs(im(z)), 2 * up))
    a, b = F.when(re(z) >= 0, up).otherwise(side), F.when(re(z) >= 0, side).otherwise(up)
    return complex_(a, F.when(im(z) < 0, -b).otherwise(b))


def power_any(a: Column, b: Column) -> Column:
    return exp(times(ln(a), b))


@_bound
def sin(z: Column) -> Column:
    return complex_(F.sin(re(z)) * F.cosh(im(z)), F.cos(re(z)) * F.sinh(im(z)))


@_bound
def cos(z: Column) -> Column:
    return complex_(F.cos(re(z)) * F.cosh(im(z)), -F.sin(re(z)) * F.sinh(im(z)))


@_bound
def tan(z: Column) -> Column:
    return over(sin(z), cos(z))


@_bound
def sinh(z: Column) -> Column:
    return complex_(F.sinh(re(z)) * F.cos(im(z)), F.cosh(re(z)) * F.sin(im(z)))


@_bound
def cosh(z: Column) -> Column:
    return complex_(F.cosh(re(z)) * F.cos(im(z)), F.sinh(re(z)) * F.sin(im(z)))


@_bound
def tanh(z: Column) -> Column:
    return over(sinh(z), cosh(z))


def _turn(z: Column) -> Column:
    """i times z."""
    return complex_(-im(z), re(z))


@_bound
def arcsinh(z: Column) -> Column:
    one = complex_(F.lit(1.0), F.lit(0.0))
    return ln(plus(z, sqrt(plus(times(z, z), one))))


@_bound
def arcsin(z: Column) -> Column:
    w = arcsinh(_turn(z))
    return complex_(im(w), -re(w))


@_bound
def arccos(z: Column) -> Column:
    w = arcsin(z)
    return complex_(F.lit(1.5707963267948966) - re(w), -im(w))


@_bound
def arccosh(z: Column) -> Column:
    one = complex_(F.lit(1.0), F.lit(0.0))
    return ln(plus(z, times(sqrt(plus(z, one)), sqrt(minus(z, one)))))


@_bound
def arctanh(z: Column) -> Column:
    one = complex_(F.lit(1.0), F.lit(0.0))
    return _scaled(minus(ln(plus(one, z)), ln(minus(one, z))), 2.0)


@_bound
def arctan(z: Column) -> Column:
    w = arctanh(_turn(z))
    return complex_(im(w), -re(w))


@_bound
def sign(z: Column) -> Column:
    """z over its magnitude; 0 for 0."""
    m = magnitude(z)
    return complex_(F.when(m == 0, 0.0).otherwise(F.try_divide(re(z), m)), F.when(m == 0, 0.0).otherwise(F.try_divide(im(z), m)))


def equal(a: Column, b: Column) -> Column:
    return (re(a) == re(b)) & (im(a) == im(b))
