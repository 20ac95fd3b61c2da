"""Dates, wall-clock times (``timestamp_ntz``), durations (day-time intervals) and times of day (nanoseconds, bigint)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.logic import ColumnOrName, col

DAY_NANOS = 86_400_000_000_000


def today(on: datetime.date | None = None) -> Column:
    """The date as a literal of the plan, so that all tasks and retries see the same; ``on`` stands in for the clock."""
    return F.lit(on or datetime.datetime.now(datetime.UTC).date())


def now(at: datetime.datetime | None = None) -> Column:
    return F.lit((at or datetime.datetime.now(datetime.UTC)).replace(tzinfo=None)).cast("timestamp_ntz")


def year(x: ColumnOrName) -> Column:
    return F.year(col(x)).cast("bigint")


def month(x: ColumnOrName) -> Column:
    return F.month(col(x)).cast("bigint")


def day(x: ColumnOrName) -> Column:
    return F.day(col(x)).cast("bigint")


def quarter(x: ColumnOrName) -> Column:
    return F.quarter(col(x)).cast("bigint")


def ordinal_day(x: ColumnOrName) -> Column:
    return F.dayofyear(col(x)).cast("bigint")


def weekday(x: ColumnOrName) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(col(x)) + 1).cast("bigint")


def week(x: ColumnOrName) -> Column:
    """ISO week."""
    return F.weekofyear(col(x)).cast("bigint")


def hour(x: ColumnOrName) -> Column:
    return F.hour(col(x)).cast("bigint")


def minute(x: ColumnOrName) -> Column:
    return F.minute(col(x)).cast("bigint")


def second(x: ColumnOrName) -> Column:
    return F.second(col(x)).cast("bigint")


def wall_micros(x: ColumnOrName) -> Column:
    """Microseconds of the wall clock since 1970."""
    return F.unix_micros(F.to_utc_timestamp(col(x).cast("timestamp_ntz"), "UTC"))


def microsecond(x: ColumnOrName) -> Column:
    """What is left after the second, in microseconds."""
    return F.pmod(wall_micros(x), F.lit(1_000_000))


def millisecond(x: ColumnOrName) -> Column:
    return F.floor(microsecond(x) / 1000)


def nanosecond(x: ColumnOrName) -> Column:
    return microsecond(x) * 1000


def date_of(x: ColumnOrName) -> Column:
    return F.to_date(col(x))


def date_text(x: ColumnOrName) -> Column:
    """``2025-01-31``; a year past 9999 has no sign before it, as SQL's text of a date (Spark's cast writes ``+10000``)."""
    return F.ltrim(col(x).cast("string"), F.lit("+"))


def time_of(x: ColumnOrName) -> Column:
    """Nanoseconds since midnight."""
    return F.pmod(wall_micros(x), F.lit(DAY_NANOS // 1000)) * 1000


def time_plus(nanos: ColumnOrName, seconds: ColumnOrName) -> Column:
    """A time of day moved on, wrapping at midnight."""
    return F.pmod(col(nanos) + col(seconds) * 1_000_000_000, F.lit(DAY_NANOS))


def date_and_time(d: ColumnOrName, nanos: ColumnOrName) -> Column:
    return col(d).cast("timestamp_ntz") + micros_as_duration(F.floor(col(nanos) / 1000))


def is_leap_year(x: ColumnOrName) -> Column:
    y = F.year(col(x))
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def plus_days(x: ColumnOrName, n: int | Column) -> Column:
    """A Date some days on."""
    return F.date_add(col(x), n)


def plus_seconds(x: ColumnOrName, n: int | Column) -> Column:
    """A Datetime's wall clock some seconds on."""
    return col(x) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(n) if isinstance(n, int) else n).cast("decimal(18,6)"))


def plus_weeks(x: ColumnOrName, n: int) -> Column:
    return plus_days(x, 7 * n)


def _keeping_time(x: Column, d: Column, is_datetime: bool) -> Column:
    return d.cast("timestamp_ntz") + (x - F.date_trunc("day", x).cast("timestamp_ntz")) if is_datetime else d


def add_months(x: ColumnOrName, n: int | Column, is_datetime: bool = False) -> Column:
    """The same day some months on, or the last one of a shorter month; a Datetime keeps its time."""
    return _keeping_time(col(x), F.add_months(col(x), n), is_datetime)


def add_years(x: ColumnOrName, n: int, is_datetime: bool = False) -> Column:
    return add_months(x, 12 * n, is_datetime)


def month_end(x: ColumnOrName, is_datetime: bool = False) -> Column:
    return _keeping_time(col(x), F.last_day(col(x)), is_datetime)


def month_start(x: ColumnOrName, is_datetime: bool = False) -> Column:
    return _keeping_time(col(x), F.trunc(col(x), "month"), is_datetime)


def days_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Difference of dates in days."""
    return F.datediff(col(later), col(earlier)).cast("bigint")


def duration(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Difference of two wall clocks or two dates as a day-time interval."""
    return micros_as_duration(wall_micros(later) - wall_micros(earlier))


def duration_micros(x: ColumnOrName) -> Column:
    """An interval as microseconds."""
    x = col(x).cast("interval day to second")
    part = lambda f: F.extract(F.lit(f), x)
    return (part("DAY").cast("bigint") * 86_400 + part("HOUR").cast("bigint") * 3600 + part("MINUTE").cast("bigint") * 60) * 1_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def micros_as_duration(micros: ColumnOrName) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (col(micros).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def scale_duration(x: ColumnOrName, factor: ColumnOrName) -> Column:
    """A duration times a number, to the nearest microsecond."""
    return micros_as_duration(F.round(duration_micros(x).cast("decimal(20,0)") * col(factor).cast("decimal(17,6)"), 0).cast("bigint"))


def _total(x: ColumnOrName, micros: int) -> Column:
    return F.round(duration_micros(x).cast("decimal(20,0)") / F.lit(micros).cast("decimal(11,0)"), 10).cast("decimal(38,10)")


def total_days(x: ColumnOrName) -> Column:
    return _total(x, 86_400_000_000)


def total_hours(x: ColumnOrName) -> Column:
    return _total(x, 3_600_000_000)


def total_minutes(x: ColumnOrName) -> Column:
    return _total(x, 60_000_000)


def total_seconds(x: ColumnOrName) -> Column:
    return _total(x, 1_000_000)


def convert_time_zone(x: ColumnOrName, source: str, target: str) -> Column:
    """The same instant on another zone's clocks. A time that the source skips is read as if its clocks had not gone
    forward, one shown twice is the first."""
    return F.convert_timezone(F.lit(source), F.lit(target), col(x))


def utc(x: ColumnOrName, zone: str) -> Column:
    return convert_time_zone(x, zone, "UTC")


def local(x: ColumnOrName, zone: str) -> Column:
    return convert_time_zone(x, "UTC", zone)


def base_utc_offset(x: ColumnOrName, zone: str) -> Column:
    """Seconds that the zone is ahead of UTC at its own winter clock in the year of the value."""
    january, july = F.make_timestamp_ntz(F.year(col(x)), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp_ntz(F.year(col(x)), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    ahead = lambda t: (wall_micros(t) - wall_micros(utc(t, zone))) / 1_000_000
    return F.least(ahead(january), ahead(july)).cast("bigint")


def utc_offset(x: ColumnOrName, zone: str) -> Column:
    """Seconds that the zone's clocks are ahead of UTC at that time."""
    return F.floor((wall_micros(x) - wall_micros(utc(x, zone))) / 1_000_000)


def instants_between(later: ColumnOrName, later_zone: str, earlier: ColumnOrName, earlier_zone: str) -> Column:
    """Difference of two zoned values, taken of their instants."""
    return duration(utc(later, later_zone), utc(earlier, earlier_zone))
