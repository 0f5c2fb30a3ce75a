"""Dates, differences and buckets. Sessions are expected to run in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_HOUR = 3_600_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _micros(c: Column | str) -> Column:
    return F.unix_micros(_col(c).cast("timestamp"))


def parse_time(text: Column | str) -> Column:
    """ISO-8601 text to a timestamp; text that is no date gives null."""
    return F.try_to_timestamp(_col(text))


def day_key(df: DataFrame, name: str) -> Column:
    """The calendar day to group by: a date, or the first ten characters of text.

    A date is cheaper to group by than its text, and is only written out later.
    """
    if df.schema[name].dataType.simpleString() == "string":
        return F.substring(name, 1, 10)
    return F.to_date(name)


def day_text(ts: Column | str) -> Column:
    """``yyyy-MM-dd`` of a timestamp, or the first ten characters of text."""
    return F.substring(_col(ts).cast("string"), 1, 10)


def month_text(ts: Column | str) -> Column:
    return F.substring(_col(ts).cast("string"), 1, 7)


def calendar_days(start: Column | str, end: Column | str) -> Column:
    """Difference of calendar dates, ignoring the time of day."""
    return F.date_diff(_col(end), _col(start))


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Elapsed days rounded down, also for a negative difference."""
    return F.floor((_micros(end) - _micros(start)) / F.lit(MICROS_PER_DAY)).cast("bigint")


def inclusive_days(start: Column | str, end: Column | str) -> Column:
    return whole_days(start, end) + 1


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed hours with their fraction."""
    return (_micros(end) - _micros(start)) / F.lit(MICROS_PER_HOUR)


def month_start(ts: Column | str) -> Column:
    return F.date_trunc("month", _col(ts))
