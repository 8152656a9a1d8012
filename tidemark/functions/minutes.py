"""Minute stamps, buckets and the time spine.

Stamps are ``timestamp_ntz`` from end to end, so no result depends on the session
time zone. ``date_trunc`` and ``date_format`` are avoided: they go through a zoned
timestamp and shift values that fall into a clock-change gap.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a 12-digit stamp YYYYMMDDHHmm, possibly with a float tail.
STAMP_PATTERN = r"^[0-9]{12}(\..*)?$"


def digits(col: Column | str) -> Column:
    """A number or text without an exponent: a double of twelve digits casts to ``2.02E11``."""
    text = F.trim(_col(col).cast("string"))
    plain = text.try_cast("double").try_cast("decimal(20,1)").cast("string")
    return F.when(text.rlike(r"^[0-9.]+[eE]\+?[0-9]+$"), plain).otherwise(text)


def parse_minute(col: Column | str) -> Column:
    """Text or number ``YYYYMMDDHHmm`` to ``timestamp_ntz``; null when it is none."""
    return minute_of_digits(digits(col))


def minute_of_digits(text: Column) -> Column:
    """The same of ``digits``."""

    def part(start: int, length: int) -> Column:
        return F.substring(text, start, length).cast("int")

    stamp = F.try_make_timestamp_ntz(
        part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2), F.lit(0).cast("decimal(16,6)")
    )
    return F.when(text.rlike(STAMP_PATTERN), stamp)


def floor_bucket(col: Column | str, step_minutes: int = 10) -> Column:
    """P5: start of the bucket that holds the stamp (plain arithmetic on the long value)."""
    return F.window(_col(col), f"{step_minutes} minutes").start


def parse_day(col: Column | str) -> Column:
    """Day from ``YYYYMMDD`` text or number; null when it is none."""
    return day_of_digits(digits(col))


def day_of_digits(text: Column) -> Column:
    """The same of ``digits``."""
    stamp = F.try_make_timestamp_ntz(
        F.substring(text, 1, 4).cast("int"),
        F.substring(text, 5, 2).cast("int"),
        F.substring(text, 7, 2).cast("int"),
        F.lit(0),
        F.lit(0),
        F.lit(0).cast("decimal(16,6)"),
    )
    return F.when(text.rlike(r"^[0-9]{8}(\.0*)?$"), stamp.cast("date"))


def period_start(day: Column | str, period: str = "day") -> Column:
    """First day of the period in which running totals accumulate."""
    day = _col(day)
    if period == "day":
        return day
    if period == "month":
        return F.make_date(F.year(day), F.month(day), F.lit(1))
    return F.make_date(F.year(day), F.lit(1), F.lit(1))


def period_end(start: Column | str, period: str = "day") -> Column:
    """Last day of that period."""
    start = _col(start)
    if period == "day":
        return start
    if period == "month":
        return F.last_day(start)
    return F.make_date(F.year(start), F.lit(12), F.lit(31))


def at_time(day: Column | str, minute_of_day: int) -> Column:
    """The stamp ``minute_of_day`` minutes into the day."""
    return _col(day).cast("timestamp_ntz") + step(minute_of_day)


def spine_points(start: Column | str, end: Column | str, step_minutes: int = 10) -> Column:
    """G1: all bucket stamps from start to end, both included, as an array.

    Both ends must already lie on bucket starts.
    """
    return F.sequence(_col(start), _col(end), step(step_minutes))


def step(minutes: int) -> Column:
    """An interval of so many minutes."""
    return F.expr(f"INTERVAL '{minutes}' MINUTE")


def minute_text(col: Column | str) -> Column:
    """Stamp as ``YYYYMMDDHHmm`` text."""
    digits = F.regexp_replace(_col(col).cast("string"), "[^0-9]", "")
    return F.substring(digits, 1, 12)


def day_number(col: Column | str) -> Column:
    """Day as the integer ``YYYYMMDD``."""
    return F.regexp_replace(_col(col).cast("date").cast("string"), "-", "").cast("int")


def minute_of_day(value: str | int | None, default: int) -> int:
    """``"HH:MM"``, ``"HHMM"`` or minutes since midnight to minutes since midnight."""
    if value is None:
        return default
    if isinstance(value, int):
        minutes = value
    else:
        digits = value.replace(":", "")
        if len(digits) != 4 or not digits.isdigit() or int(digits[2:]) > 59:
            raise ValueError(f"not a time of day: {value!r}")
        minutes = int(digits[:2]) * 60 + int(digits[2:])
    if not 0 <= minutes < 1440:
        raise ValueError(f"not a time of day: {value!r}")
    return minutes


def as_date(value: dt.date | str | int) -> dt.date:
    """A day given as a date, ``YYYYMMDD`` or ``YYYY-MM-DD``."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(str(value).replace("-", ""), "%Y%m%d").date()


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
