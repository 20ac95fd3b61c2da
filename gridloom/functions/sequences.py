"""Sequence columns in closed form over a dense row number that starts at 0.

A sequence stops at its limit and leaves the rows after it empty. Rules over earlier rows' cells are in
``operators.recurrences``; ``own_terms`` are those of rules that read nothing but the sequence itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.logic import ColumnOrName, col

# Names that go round.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def arithmetic(row: ColumnOrName, first: float, second: float | None = None, limit: float | None = None) -> Column:
    """``first, second ... limit``; one term alone steps by one."""
    step = (first + 1 if second is None else second) - first
    x = F.lit(first) + col(row) * F.lit(step)
    if limit is None:
        return x
    return F.when(x <= limit if step >= 0 else x >= limit, x)


def geometric(row: ColumnOrName, first: float, ratio: float, limit: float | None = None) -> Column:
    x = F.lit(float(first)) * F.pow(F.lit(float(ratio)), col(row))
    return x if limit is None else F.when(x <= limit if ratio >= 1 else x >= limit, x)


def dates_by_days(row: ColumnOrName, first: str, days: int = 1) -> Column:
    return F.date_add(F.lit(first).cast("date"), (col(row) * days).cast("int"))


def dates_by_months(row: ColumnOrName, first: str, months: int, day: int) -> Column:
    """The same ``day`` of each month, or the last one of a shorter month."""
    start = F.add_months(F.trunc(F.lit(first).cast("date"), "month"), (col(row) * months).cast("int"))
    return F.date_add(start, F.least(F.lit(day), F.day(F.last_day(start))) - 1)


def times_by_seconds(row: ColumnOrName, first: str, seconds: int) -> Column:
    return F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (col(row) * seconds).cast("decimal(18,6)"))


def cycle(row: ColumnOrName, names: tuple[str, ...], start: str, short: bool = False) -> Column:
    """Names that go round, whole or in three letters."""
    shown = [n[:3] if short else n for n in names]
    return F.element_at(F.array(*map(F.lit, shown)), (F.pmod(col(row) + shown.index(start), F.lit(len(shown))) + 1).cast("int"))


def months_with_year(row: ColumnOrName, first: str, months: int = 1) -> Column:
    """``Jan-2026`` and on, carrying into the year."""
    name, year = first.split("-")
    at = F.lit(12 * int(year) + [m[:3] for m in MONTHS].index(name)) + col(row) * months
    return F.concat(F.element_at(F.array(*[F.lit(m[:3]) for m in MONTHS]), (F.pmod(at, F.lit(12)) + 1).cast("int")), F.lit("-"), F.floor(at / 12).cast("string"))


def letters(row: ColumnOrName, first: str = "A") -> Column:
    """``A, B ... Z, AA, AB``: bijective base 26, worked out digit by digit."""
    start = 0
    for c in first:
        start = start * 26 + ord(c) - 64
    begin = F.struct((col(row) + start).cast("bigint").alias("n"), F.lit("").alias("s"))
    grow = lambda a, _: F.when(a.n > 0, F.struct(F.floor((a.n - 1) / 26).alias("n"), F.concat(F.char((F.pmod(a.n - 1, F.lit(26)) + 65).cast("bigint")), a.s).alias("s"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), begin, grow)["s"]


def own_terms(first: list[float], rule: Callable[[list[float]], float], limit: float, most: int = 10_000) -> list[float]:
    """``0, 1, $-1 + $-2 ... limit``: the first terms and those that the rule makes of all before, up to the limit. A
    sequence that has not passed its limit after ``most`` terms is an error: such terms are small tables, not columns of
    rows."""
    terms = [t for t in first if t <= limit]
    while len(terms) >= len(first) and (term := rule(terms)) <= limit:
        if len(terms) == most:
            raise ValueError(f"the sequence does not reach {limit} in {most} terms")
        terms.append(term)
    return terms


def listed(row: ColumnOrName, terms: list[float]) -> Column:
    """Terms by row; null after the last."""
    return F.try_element_at(F.array(*map(F.lit, terms)), (col(row) + 1).cast("int")) if terms else F.lit(None)
