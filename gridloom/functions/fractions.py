"""Fractions as ``struct<num:decimal(38,0), den:decimal(38,0)>``, reduced, the denominator above 0.

Exact while numerators and denominators keep within 18 digits before a product; past that ANSI arithmetic is an error
rather than a rounded answer. Division by zero gives null here, the float quotient (``arithmetic.divide``) Inf.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.logic import ColumnOrName, col, let

WIDE = "decimal(38,0)"
NARROW = "decimal(18,0)"


def _euclid(low: Column, high: Column, kind: str) -> Column:
    """Euclid's algorithm takes at most five steps for each digit of the smaller number (Lamé)."""
    start = F.struct(high.cast(kind).alias("a"), low.cast(kind).alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.try_mod(s.a, s.b).cast(kind).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), 5 * F.length(low.cast("string"))), start, step)["a"]


def _gcd(a: Column, b: Column) -> Column:
    """In 64-bit whole numbers where both have at most 18 digits, else in decimals."""
    either = lambda low, high: F.when(high < 10**18, _euclid(low, high, "bigint").cast(WIDE)).otherwise(_euclid(low, high, WIDE))
    return let(either, F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b)))


def fraction(num: ColumnOrName | int, den: ColumnOrName | int) -> Column:
    """Two plain numbers are reduced at once, columns row by row."""
    if isinstance(num, int) and isinstance(den, int):
        num, den = Fraction(num, den).as_integer_ratio() if den else (num, den)
        return F.when(F.lit(den != 0), F.struct(F.lit(str(num)).cast(WIDE).alias("num"), F.lit(str(den)).cast(WIDE).alias("den")))
    num, den = (F.lit(str(x)) if isinstance(x, int) else x for x in (num, den))

    def reduced(n: Column, d: Column) -> Column:
        return let(lambda n, d, g: F.struct((_part(n, g) * _sign(d)).cast(WIDE).alias("num"), (_part(d, g) * _sign(d)).cast(WIDE).alias("den")), n, d, _gcd(n, d))

    return let(lambda n, d: F.when(n.isNotNull() & (d != 0), reduced(n, d)), col(num).cast(WIDE), col(den).cast(WIDE))


def _part(x: Column, g: Column) -> Column:
    return F.try_divide(x, g).cast(WIDE)


def _sign(d: Column) -> Column:
    return F.when(d < 0, -1).otherwise(1)


def whole(x: ColumnOrName) -> Column:
    return F.when(col(x).isNotNull(), F.struct(col(x).cast(WIDE).alias("num"), F.lit(1).cast(WIDE).alias("den")))


def _n(x: Column) -> Column:
    return x["num"].cast(NARROW)


def _d(x: Column) -> Column:
    return x["den"].cast(NARROW)


def plus(a: Column, b: Column) -> Column:
    return let(lambda a, b: fraction(_n(a) * _d(b) + _n(b) * _d(a), _d(a) * _d(b)), a, b)


def minus(a: Column, b: Column) -> Column:
    return let(lambda a, b: fraction(_n(a) * _d(b) - _n(b) * _d(a), _d(a) * _d(b)), a, b)


def times(a: Column, b: Column) -> Column:
    return let(lambda a, b: fraction(_n(a) * _n(b), _d(a) * _d(b)), a, b)


def over(a: Column, b: Column) -> Column:
    return let(lambda a, b: fraction(_n(a) * _d(b), _d(a) * _n(b)), a, b)


def less(a: Column, b: Column) -> Column:
    return let(lambda a, b: _n(a) * _d(b) < _n(b) * _d(a), a, b)


def equal(a: Column, b: Column) -> Column:
    return let(lambda a, b: (a["num"] == b["num"]) & (a["den"] == b["den"]), a, b)


def as_decimal(x: Column, scale: int = 10) -> Column:
    return let(lambda x: F.round(x["num"].cast("decimal(27,10)") / x["den"].cast("decimal(10,0)"), scale).cast(f"decimal(38,{scale})"), x)


def as_float(x: Column) -> Column:
    return let(lambda x: x["num"].cast("double") / x["den"].cast("double"), x)


def show(x: Column) -> Column:
    """``3``, ``1/7``, ``2 3/4``."""
    return let(_shown, x)


def _shown(x: Column) -> Column:
    n, d = F.abs(x["num"]), x["den"]
    w = F.floor(F.try_divide(n, d)).cast(WIDE)
    rest = F.concat((n - w * d).cast(WIDE).cast("string"), F.lit("/"), d.cast("string"))
    text = F.when(d == 1, n.cast("string")).when(w == 0, rest).otherwise(F.concat(w.cast("string"), F.lit(" "), rest))
    return F.when(x["num"] < 0, F.concat(F.lit("-"), text)).otherwise(text)
