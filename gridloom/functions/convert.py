"""Conversions by a type's name. Text is read as a cell is; what does not fit is an error (``try_`` forms give null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.logic import ColumnOrName, col


def integer(x: ColumnOrName) -> Column:
    """Truncates towards zero."""
    return col(x).cast("bigint")


def decimal(x: ColumnOrName, scale: int = 10) -> Column:
    """Rounded half away from zero to the scale."""
    return col(x).cast(f"decimal(38,{scale})")


def float_(x: ColumnOrName) -> Column:
    return col(x).cast("double")


def string(x: ColumnOrName) -> Column:
    return col(x).cast("string")


def boolean(x: ColumnOrName) -> Column:
    """False for zero, true for other numbers."""
    return col(x) != 0


def boolean_cell(x: ColumnOrName) -> Column:
    """Text of a Boolean column: ``true false``, ``1 0`` and ``x o``; other text is an error."""
    x = col(x)
    bad = F.raise_error(F.concat(F.lit("not a Boolean: "), x)).cast("boolean")
    return F.when(x.isin("true", "1", "x"), True).when(x.isin("false", "0", "o"), False).when(x.isNotNull(), bad)


def number_cell(x: ColumnOrName, scale: int = 10) -> Column:
    """Text of a numeric cell as a decimal: digits grouped by ``_``, percentages, fractions ``1/2`` and ``2 3/4``, and
    whole numbers in base 16, 8 or 2; other text is null."""
    x = F.trim(F.replace(col(x), F.lit("_"), F.lit("")))
    wide = f"decimal(27,{scale})"
    plain = x.rlike(r"^-?\d+(\.\d+)?$")
    percent = x.rlike(r"^-?\d+(\.\d+)?%$")
    based = x.rlike(r"^0x[0-9a-fA-F]{1,15}$|^0o[0-7]{1,20}$|^0b[01]{1,62}$")
    base = F.when(x.startswith("0x"), 16).when(x.startswith("0o"), 8).otherwise(2)
    parts = r"^(-?)(?:(\d+) )?(\d+)/(\d+)$"
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(x, parts, k), F.lit("")), F.lit("9" * 18))
    fraction = F.when(F.regexp_extract(x, parts, 1) == "-", -1).otherwise(1) * (F.coalesce(part(2), F.lit(0)) + F.try_divide(part(3).cast(wide), part(4).cast("decimal(10,0)")))
    per_cent = (F.regexp_replace(x, "%$", "").try_cast(wide) / F.lit(100).cast("decimal(3,0)")).cast(f"decimal(38,{scale})")
    whole = F.conv(F.substring(x, 3, 64), 2, 10)
    whole = F.when(base == 16, F.conv(F.substring(x, 3, 64), 16, 10)).when(base == 8, F.conv(F.substring(x, 3, 64), 8, 10)).otherwise(whole)
    out = f"decimal(38,{scale})"
    return F.when(plain, x.try_cast(out)).when(percent, per_cent).when(based, whole.try_cast(out)).when(x.rlike(parts), F.round(fraction, scale).cast(out))


def date(x: ColumnOrName) -> Column:
    """Of text ``2025-01-31`` or of a Datetime."""
    return col(x).cast("date")


def datetime(x: ColumnOrName) -> Column:
    """Of a Date at midnight, or of text."""
    return col(x).cast("timestamp_ntz")


def duration_cell(x: ColumnOrName) -> Column:
    """ISO 8601 text of days, hours, minutes and seconds (``P1DT2H30M``) as a day-time interval; other text is null."""
    x = col(x)
    shape = r"^(-?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(x, shape, k), F.lit("")).try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    seconds = part(2) * 604800 + part(3) * 86400 + part(4) * 3600 + part(5) * 60 + part(6)
    signed = F.when(F.regexp_extract(x, shape, 1) == "-", -seconds).otherwise(seconds)
    return F.when(x.rlike(shape), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), signed.cast("decimal(18,6)")))


def time_cell(x: ColumnOrName) -> Column:
    """Text ``09:30`` or ``09:30:15.5`` as nanoseconds since midnight; other text is null."""
    x = col(x)
    shape = r"^([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(\.\d{1,9})?)?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(x, shape, k), F.lit("")).try_cast("bigint"), F.lit(0))
    nanos = F.rpad(F.regexp_replace(F.regexp_extract(x, shape, 4), r"^\.", ""), 9, "0").try_cast("bigint")
    return F.when(x.rlike(shape), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1_000_000_000 + F.coalesce(nanos, F.lit(0)))
