"""Functions of floats. The edge of a domain gives ±Inf; a real argument past it has a complex answer, which a float
column cannot hold: that is an error, or NaN with ``strict=False``. ``functions.complexes`` has the complex forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.arithmetic import INF, NAN
from gridloom.functions.logic import ColumnOrName, col


def _within(x: Column, inside: Column, result: Column, name: str, strict: bool) -> Column:
    beyond = F.raise_error(F.concat(F.lit(f"{name} of "), x.cast("string"), F.lit(" is complex"))).cast("double") if strict else F.lit(NAN)
    return F.when(F.isnan(x), NAN).when(inside, result).when(x.isNotNull(), beyond)


def _log(x: ColumnOrName, f, name: str, strict: bool) -> Column:
    x = col(x).cast("double")
    return _within(x, x >= 0, F.when(x == 0, -INF).otherwise(f(x)), name, strict)


def ln(x: ColumnOrName, strict: bool = True) -> Column:
    return _log(x, F.ln, "ln", strict)


def log10(x: ColumnOrName, strict: bool = True) -> Column:
    return _log(x, F.log10, "log10", strict)


def log2(x: ColumnOrName, strict: bool = True) -> Column:
    return _log(x, F.log2, "log2", strict)


def sqrt(x: ColumnOrName, strict: bool = True) -> Column:
    x = col(x).cast("double")
    return _within(x, x >= 0, F.sqrt(x), "sqrt", strict)


def exp(x: ColumnOrName) -> Column:
    return F.exp(col(x).cast("double"))


def sin(x: ColumnOrName) -> Column:
    return F.sin(col(x).cast("double"))


def cos(x: ColumnOrName) -> Column:
    return F.cos(col(x).cast("double"))


def tan(x: ColumnOrName) -> Column:
    return F.tan(col(x).cast("double"))


def arcsin(x: ColumnOrName, strict: bool = True) -> Column:
    x = col(x).cast("double")
    return _within(x, x.between(-1, 1), F.asin(x), "arcsin", strict)


def arccos(x: ColumnOrName, strict: bool = True) -> Column:
    x = col(x).cast("double")
    return _within(x, x.between(-1, 1), F.acos(x), "arccos", strict)


def arctan(x: ColumnOrName) -> Column:
    return F.atan(col(x).cast("double"))


def sinh(x: ColumnOrName) -> Column:
    return F.sinh(col(x).cast("double"))


def cosh(x: ColumnOrName) -> Column:
    return F.cosh(col(x).cast("double"))


def tanh(x: ColumnOrName) -> Column:
    return F.tanh(col(x).cast("double"))


def arcsinh(x: ColumnOrName) -> Column:
    return F.asinh(col(x).cast("double"))


def arccosh(x: ColumnOrName, strict: bool = True) -> Column:
    x = col(x).cast("double")
    return _within(x, x >= 1, F.acosh(x), "arccosh", strict)


def arctanh(x: ColumnOrName, strict: bool = True) -> Column:
    """±Inf at ±1."""
    x = col(x).cast("double")
    edge = F.when(x == 1, INF).when(x == -1, -INF).otherwise(F.atanh(x))
    return _within(x, x.between(-1, 1), edge, "arctanh", strict)


def radians(x: ColumnOrName) -> Column:
    return F.radians(col(x).cast("double"))


def degrees(x: ColumnOrName) -> Column:
    return F.degrees(col(x).cast("double"))
