"""Arithmetic: floats by IEEE, exact numbers as decimals that are rounded once, whole numbers that do not overflow.

Decimal results are settled to a stated scale, half away from zero. Spark keeps at most 38 digits, so operands are first
narrowed to the precision their values have (``digits``); a value with more is an error, never a silent loss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.logic import ColumnOrName, col

INF = float("inf")
NAN = float("nan")
#: Mathematical constants, and physical ones in SI units (CODATA 2018; e, c, kB, NA, planck are exact).
CONSTANTS = {
    "pi": 3.141592653589793,
    "tau": 6.283185307179586,
    "e": 2.718281828459045,
    "c": 299792458.0,
    "gn": 9.80665,
    "planck": 6.62607015e-34,
    "hbar": 1.054571817e-34,
    "kB": 1.380649e-23,
    "NA": 6.02214076e23,
    "R": 8.31446261815324,
    "qe": 1.602176634e-19,
    "G": 6.6743e-11,
    "me": 9.1093837015e-31,
}


def divide(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Float quotient; by zero ±Inf, and NaN for 0/0."""
    x, y = col(x).cast("double"), col(y).cast("double")
    by_zero = F.when(x > 0, F.when(F.isnan(x), NAN).otherwise(INF)).when(x < 0, -INF).otherwise(NAN)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(y != 0, F.try_divide(x, y)).otherwise(by_zero))


def floor_mod(x: ColumnOrName, y: ColumnOrName) -> Column:
    """What is left of x after whole steps of y downwards, so with y's sign; whole numbers stay whole, by zero null."""
    x, y = col(x), col(y)
    rest = F.try_mod(x, y)
    return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)


def floor_mod_float(x: ColumnOrName, y: ColumnOrName) -> Column:
    """As ``floor_mod`` in floats; by zero NaN."""
    x, y = col(x).cast("double"), col(y).cast("double")
    return F.when(y != 0, x - F.floor(F.try_divide(x, y)).cast("double") * y).when(x.isNotNull() & y.isNotNull(), NAN)


def settle(x: Column, scale: int) -> Column:
    """An exact result at a column's scale."""
    return F.round(x, scale).cast(f"decimal(38,{scale})")


def exact(x: ColumnOrName, scale: int, digits: int = 18) -> Column:
    return col(x).cast(f"decimal({digits},{scale})")


def times(x: ColumnOrName, y: ColumnOrName, scale: int, digits: int = 18) -> Column:
    """Product of decimals of ``scale`` places at most, worked out exactly and rounded once to ``scale``."""
    return settle(exact(x, scale, digits) * exact(y, scale, digits), scale)


def over(x: ColumnOrName, y: ColumnOrName, scale: int = 10, left: tuple[int, int] = (18, 4), right: tuple[int, int] = (9, 2)) -> Column:
    """Quotient of decimals at ten places or the finer scale; by zero null (``divide`` gives Inf). ``left`` and ``right``:
    digits and places of the operands, narrow enough that Spark works the quotient out past those places."""
    places = max(scale, 10)
    return settle(F.try_divide(exact(x, left[1], left[0]), exact(y, right[1], right[0])), places)


def power(x: ColumnOrName, n: int) -> Column:
    """A small whole power by repeated products, exact for decimals that have the digits."""
    if n == 0:
        return F.when(col(x).isNotNull(), F.lit(1))
    return reduce(lambda p, q: p * q, [col(x)] * n) if n > 0 else divide(F.lit(1), power(x, -n))


def power_float(x: ColumnOrName, y: ColumnOrName) -> Column:
    return F.pow(col(x).cast("double"), col(y).cast("double"))


def absolute(x: ColumnOrName) -> Column:
    return F.abs(col(x))


def sign(x: ColumnOrName) -> Column:
    """-1, 0 or 1 as a whole number."""
    x = col(x)
    return F.when(x > 0, 1).when(x < 0, -1).when(x.isNotNull(), 0).cast("bigint")


def round_whole(x: ColumnOrName) -> Column:
    """Half away from zero; a float stays a float."""
    return F.round(col(x), 0)


def floor(x: ColumnOrName) -> Column:
    """A float stays a float."""
    return F.floor(col(x)).cast("double")


def ceil(x: ColumnOrName) -> Column:
    return F.ceil(col(x)).cast("double")


def round_float(x: ColumnOrName, n: int) -> Column:
    """``(x * 10^n)`` rounded half away from zero, over ``10^n``; n is 17 at most, Inf and NaN pass."""
    x, ten = col(x).cast("double"), F.lit(float(10 ** min(n, 17)))
    big = x * ten
    whole = F.signum(big) * F.floor(F.abs(big) + 0.5).cast("double")
    # Past 2^52 a float is whole; there, and where adding a half would carry over, the value itself is its rounding.
    safe = F.when(F.abs(big) >= float(2**52), big).when(F.abs(big) == 0.49999999999999994, 0.0).otherwise(whole)
    return F.when(F.isnan(x) | (F.abs(x) == INF) | (F.abs(big) == INF), x).otherwise(safe / ten)


def round_exact(x: ColumnOrName, n: int) -> Column:
    return F.round(col(x), n)


def bit_and(x: ColumnOrName, y: ColumnOrName) -> Column:
    return col(x).cast("bigint").bitwiseAND(col(y).cast("bigint"))


def bit_or(x: ColumnOrName, y: ColumnOrName) -> Column:
    return col(x).cast("bigint").bitwiseOR(col(y).cast("bigint"))


def bit_xor(x: ColumnOrName, y: ColumnOrName) -> Column:
    return col(x).cast("bigint").bitwiseXOR(col(y).cast("bigint"))


def bit_not(x: ColumnOrName) -> Column:
    return F.bitwise_not(col(x).cast("bigint"))


def _checked(x: Column, n: Column, good: Column, result: Column) -> Column:
    why = F.concat(F.lit("shift of "), x.cast("string"), F.lit(" by "), n.cast("string"), F.lit(" bits"))
    return F.when(x.isNull() | n.isNull(), F.lit(None)).when(good, result).otherwise(F.raise_error(why).cast("bigint"))


def shift_left(x: ColumnOrName, n: int | Column) -> Column:
    """An error outside 0 to 63 bits, or where bits would be lost."""
    x, n = col(x).cast("bigint"), (F.lit(n) if isinstance(n, int) else n).cast("int")
    moved = F.call_function("shiftleft", x, n)
    return _checked(x, n, n.between(0, 63) & (F.call_function("shiftright", moved, n) == x), moved)


def shift_right(x: ColumnOrName, n: int | Column) -> Column:
    """Fills with the sign; an error outside 0 to 63 bits."""
    x, n = col(x).cast("bigint"), (F.lit(n) if isinstance(n, int) else n).cast("int")
    return _checked(x, n, n.between(0, 63), F.call_function("shiftright", x, n))
