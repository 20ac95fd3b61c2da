"""Numbers and dates as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.logic import ColumnOrName, col

# Strftime directives and Spark's patterns.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%-m": "M", "%d": "dd", "%-d": "d", "%e": "d", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%H": "HH", "%-H": "H", "%I": "hh", "%-I": "h", "%M": "mm", "%-M": "m", "%S": "ss", "%p": "a", "%j": "DDD", "%f": "SSSSSS"}


def date_pattern(format_: str) -> str:
    """A strftime format as a pattern for ``date_format``; text between directives is quoted."""
    out = []
    for part in re.split(r"(%-?[A-Za-z%])", format_):
        if part in DIRECTIVES:
            out.append(DIRECTIVES[part])
        elif part:
            text = "%" if part == "%%" else part
            out.append("'" + text.replace("'", "''") + "'")
    return "".join(out)


def show_date(x: ColumnOrName, format_: str) -> Column:
    return F.date_format(col(x), date_pattern(format_))


def fixed(x: ColumnOrName, places: int) -> Column:
    """``.2f``: half away from zero, as a decimal's digits."""
    return F.round(col(x).cast(f"decimal(27,{min(places + 6, 18)})"), places).cast(f"decimal(38,{places})").cast("string")


def grouped(x: ColumnOrName, places: int) -> Column:
    """``'.2f``: digits in threes by commas."""
    return F.format_number(F.round(col(x).cast(f"decimal(27,{min(places + 6, 18)})"), places), places)


def percent(x: ColumnOrName, places: int = 2) -> Column:
    """Hundredfold with a sign, without trailing zeros."""
    text = fixed(col(x).cast("decimal(27,10)") * 100, places)
    return F.concat(F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text), F.lit("%"))


def based(x: ColumnOrName, base: int, prefix: str) -> Column:
    """``#x``, ``#o``, ``#b``: a whole number in another base, lower case."""
    return F.concat(F.lit(prefix), F.lower(F.conv(col(x).cast("string"), 10, base)))


def scientific(x: ColumnOrName, places: int) -> Column:
    """``1.23e+02``."""
    return F.format_string(f"%.{places}e", col(x).cast("double"))


def signed(x: ColumnOrName, shown: Column) -> Column:
    """``±``: a plus before what shows a number above 0."""
    return F.when(col(x) > 0, F.concat(F.lit("+"), shown)).otherwise(shown)


def padded(shown: ColumnOrName, width: int, fill: str = " ", left: bool = False) -> Column:
    """A width in characters: at the right of it, or the left; zeros stand after a sign. Longer texts stay whole."""
    shown = col(shown)
    if left:
        return F.when(F.char_length(shown) < width, F.rpad(shown, width, fill)).otherwise(shown)
    sign = F.regexp_extract(shown, "^[+-]?", 0) if fill == "0" else F.lit("")
    rest = F.substring(shown, F.char_length(sign) + 1, F.char_length(shown))
    return F.when(F.char_length(shown) < width, F.concat(sign, F.lpad(rest, F.lit(width) - F.char_length(sign), F.lit(fill)))).otherwise(shown)


def powers_of_thousand(x: ColumnOrName, places: int, power: int) -> Column:
    """``e-3``, ``e3``, ``e6``: the number over ten to ``power``, with that power behind it."""
    return F.concat(fixed(col(x).cast("decimal(27,10)") / F.lit(10.0**power).cast("decimal(20,9)"), places), F.lit(f"e{power:+03d}"))
