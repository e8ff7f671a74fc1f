"""Dates: ages in sessions, first usable days, and text forms found in feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shocklens.functions.numbers import col


def _weekdays_until(d: Column) -> Column:
    """Weekdays from a fixed Monday to ``d`` inclusive, for differences."""
    days = F.datediff(d, F.to_date(F.lit("1900-01-01")))  # a Monday
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)) + 1, F.lit(5))


def trading_days_before(published: str | Column, day: str | Column) -> Column:
    """Weekdays after publication up to the day; negative if published later, null if a date is missing."""
    a, b = col(published), col(day)
    return (_weekdays_until(b) - _weekdays_until(a)).cast("int")


def calendar_age(published: str | Column, day: str | Column) -> Column:
    return F.datediff(col(day), col(published))


def known_from(period: str | Column, kind: str | Column) -> Column:
    """First day a monthly figure may be used: next month's first, for consumer prices its 15th."""
    nxt = F.add_months(F.trunc(col(period), "MM"), 1)
    return F.when(col(kind) == "consumer", F.date_add(nxt, 14)).otherwise(nxt)


def session_date(seen: str | Column) -> Column:
    """The day a time counts for; before 08:00 UTC it is the day before."""
    return F.to_date(col(seen) - F.expr("INTERVAL 8 HOURS"))


def seen_date(text: str | Column) -> Column:
    """Date of a yyyyMMddTHHmmssZ text, null if it is not one."""
    return F.to_date(F.try_to_timestamp(col(text), F.lit("yyyyMMdd'T'HHmmss'Z'")))


def feed_time(text: str | Column) -> Column:
    """Time of an RFC 822 date with or without a weekday, null if it is not one."""
    plain = F.regexp_replace(F.trim(col(text)), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")))


def in_window(at: str | Column, start: str | Column, end: str | Column, closed: bool = False) -> Column:
    """start <= at < end, or <= end where ``closed``."""
    return (col(at) >= col(start)) & ((col(at) <= col(end)) if closed else (col(at) < col(end)))


def year_chunks(start: str | Column, end: str | Column) -> Column:
    """array of (first, last) that cuts a date range by calendar year."""
    a, b = col(start), col(end)
    return F.transform(F.sequence(F.year(a), F.year(b)), lambda y: F.struct(F.greatest(a, F.make_date(y, F.lit(1), F.lit(1))).alias("first"), F.least(b, F.make_date(y, F.lit(12), F.lit(31))).alias("last")))
