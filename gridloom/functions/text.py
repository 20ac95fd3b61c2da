"""Text tests and case; each is null of null and compares bytes exactly as written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.logic import ColumnOrName, col


def starts_with(x: ColumnOrName, prefix: str) -> Column:
    return col(x).startswith(prefix)


def starts_within(x: ColumnOrName, first: str, last: str) -> Column:
    """First letters ``first..last``: from ``first`` up to, and without, the letter after ``last``."""
    return (col(x) >= first) & (col(x) < last[:-1] + chr(ord(last[-1]) + 1))


def ends_with(x: ColumnOrName, suffix: str) -> Column:
    return col(x).endswith(suffix)


def contains(x: ColumnOrName, part: str) -> Column:
    return col(x).contains(part)


def contains_any(x: ColumnOrName, parts: list[str]) -> Column:
    return F.when(col(x).isNotNull(), reduce(lambda p, q: p | q, [col(x).contains(p) for p in parts], F.lit(False)))


def matches(x: ColumnOrName, pattern: str) -> Column:
    """A regular expression (Java's dialect) anywhere in the text."""
    return col(x).rlike(pattern)


def len_chars(x: ColumnOrName) -> Column:
    """Code points."""
    return F.char_length(col(x)).cast("bigint")


def to_lowercase(x: ColumnOrName) -> Column:
    return F.lower(col(x))


def to_uppercase(x: ColumnOrName) -> Column:
    return F.upper(col(x))


def succ(x: ColumnOrName) -> Column:
    """The next text: the last run of letters and digits counts up, carrying at Z, z and 9 (``AZ`` to ``BA``, ``job-A9``
    to ``job-B0``); a text without such a run stays."""
    x = col(x)
    tail = F.regexp_extract(x, r"([^A-Za-z0-9]*)$", 1)
    run = F.regexp_extract(x, r"([A-Za-z0-9]*)[^A-Za-z0-9]*$", 1)
    head = F.substring(x, F.lit(1), F.char_length(x) - F.char_length(run) - F.char_length(tail))
    full = F.regexp_extract(run, r"([Zz9]*)$", 1)
    rest = F.substring(run, F.lit(1), F.char_length(run) - F.char_length(full))
    step = F.char((F.ascii(F.right(rest, F.lit(1))) + 1).cast("bigint"))
    grown = F.when(rest != "", F.concat(F.substring(rest, F.lit(1), F.char_length(rest) - 1), step)).otherwise(F.translate(F.left(full, F.lit(1)), "Zz9", "Aa1"))
    return F.when(run == "", x).otherwise(F.concat(head, grown, F.translate(full, "Zz9", "Aa0"), tail))


def succ_number(x: ColumnOrName) -> Column:
    return col(x) + 1


def to_text(x: ColumnOrName) -> Column:
    """A whole number, decimal or Boolean as a file writes it: decimals without trailing zeros."""
    text = col(x).cast("string")
    return F.when(text.contains(".") & ~text.contains("E"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


# The patterns of the validated text types.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+(/\S*)?$"
EMAIL = r"^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _valid(x: ColumnOrName, pattern: str, what: str) -> Column:
    x = col(x)
    return F.when(x.isNull(), x).when(x.rlike(pattern), x).otherwise(F.raise_error(F.concat(F.lit(f"not {what}: "), x)).cast("string"))


def url(x: ColumnOrName) -> Column:
    """The text itself where it is one; else an error."""
    return _valid(x, URL, "a URL")


def email(x: ColumnOrName) -> Column:
    return _valid(x, EMAIL, "an e-mail address")


def uuid(x: ColumnOrName) -> Column:
    return _valid(x, UUID, "a UUID")
