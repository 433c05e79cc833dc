"""Calendar truncation, date distance and refresh stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(c: Column) -> Column:
    """Monday of the week as a date."""
    return F.date_trunc("week", c).cast("date")


def month_start(c: Column) -> Column:
    return F.date_trunc("month", c).cast("date")


def month_index(month: Column, origin: Column) -> Column:
    """Whole calendar months from ``origin`` to ``month``."""
    years = F.year(month) - F.year(origin)
    return (years * F.lit(12) + F.month(month) - F.month(origin)).cast("int")


def days_between(end: Column, start: Column) -> Column:
    """Calendar days between the dates of two timestamps."""
    return F.datediff(end.cast("date"), start.cast("date"))


def within_interval(later: Column, earlier: Column, days: int) -> Column:
    """True when ``later`` is at most ``days`` days after ``earlier``, to the microsecond."""
    return later <= earlier + F.make_dt_interval(days=F.lit(days))


def coerce_date(c: Column) -> Column:
    """Timestamp from text; anything unreadable becomes NULL instead of failing."""
    return c.try_cast("timestamp_ntz")


def refresh_stamp(at: Column) -> Column:
    """A timestamp rounded (not truncated) to whole seconds."""
    half = F.make_dt_interval(secs=F.lit(0.5).cast("decimal(18,6)"))
    return F.date_trunc("second", at.cast("timestamp_ntz") + half).cast("timestamp_ntz")
