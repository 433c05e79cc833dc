"""Money, rates, midpoints and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# Averages are taken over this type, which leaves twelve decimals before rounding.
WIDE = "decimal(20,8)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast(MONEY))


def sum_or_zero(c: Column, scale: int = 2) -> Column:
    """Rounded sum that reads a missing amount as zero."""
    return F.round(F.sum(or_zero(c)), scale)


def rate(num: Column, den: Column, scale: int = 4) -> Column:
    """``num / den`` in decimal arithmetic, NULL when the denominator is zero."""
    return F.round(num.cast("decimal(28,4)") / F.nullif(den.cast("decimal(28,4)"), F.lit(0)), scale)


def money_avg(c: Column, scale: int = 2) -> Column:
    return F.round(F.avg(c.cast(WIDE)), scale)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(value: Column, condition: Column) -> Column:
    """Sum over the rows that pass; NULL when none does."""
    return F.sum(F.when(condition, value))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Inclusive tolerance band. A float difference is compared as a double."""
    return F.abs(a - b) <= F.lit(tolerance)


def midpoint_int(low: Column, high: Column) -> Column:
    """Integer midpoint truncated toward zero; NULL when either end is missing."""
    total = low.cast("bigint") + high.cast("bigint")
    return (total / F.lit(2)).cast("int")


def midpoint_float(low: Column, high: Column) -> Column:
    """Midpoint as a double; the ends are added in their own type first."""
    return (low + high).cast("double") / F.lit(2.0)


def round_half_even_int(c: Column) -> Column:
    """Nearest integer, ties to even, as an implicit double-to-integer insert does."""
    return F.bround(c).cast("int")


def strip_non_numeric(c: Column) -> Column:
    """Keep digits and dots of the textual form, then read it as a float."""
    digits = F.regexp_replace(c.cast("string"), "[^0123456789.]", "")  # no range: Java looks single characters up
    return F.nullif(digits, F.lit("")).try_cast("float")


def extract_number(c: Column) -> Column:
    """First run of digits and dots as a double; NULL when there is none."""
    run = F.regexp_extract(c.cast("string"), r"([\d\.]+)", 1)
    return F.nullif(run, F.lit("")).try_cast("double")


def strip_plus(c: Column) -> Column:
    """``'1+'`` to 1.0; blank or unreadable text becomes NULL."""
    return F.trim(F.replace(c, F.lit("+"), F.lit(""))).try_cast("double")


def quantized(c: Column, scale: int = 6) -> Column:
    """A double on a fixed decimal grid, so results do not depend on the last bit."""
    return c.cast(f"decimal(38,{scale})")
