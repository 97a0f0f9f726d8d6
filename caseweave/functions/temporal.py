"""Time expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col


def hour_or_zero(ts: Column | str) -> Column:
    return F.coalesce(F.hour(_col(ts)), F.lit(0))


def weekday_or_zero(ts: Column | str) -> Column:
    """Monday = 0; a missing time counts as Monday."""
    return F.coalesce(F.weekday(_col(ts)), F.lit(0))


def tod_bucket(hour: Column | str) -> Column:
    h = _col(hour)
    return (F.when(h.between(0, 5), "night").when(h.between(6, 11), "morning")
            .when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening")
            .otherwise("late_evening"))


def days_apart(a: Column | str, b: Column | str) -> Column:
    return F.abs(F.datediff(_col(a), _col(b)))


def week_start(ts: Column | str) -> Column:
    """Monday of the week as a date."""
    return F.date_trunc("week", _col(ts)).cast("date")


def month_start(ts: Column | str) -> Column:
    return F.date_trunc("month", _col(ts)).cast("date")


def lenient_timestamp(c: Column | str) -> Column:
    """Text to timestamp; anything unreadable becomes NULL."""
    return F.try_to_timestamp(_col(c))


def lenient_date(c: Column | str) -> Column:
    return F.try_to_timestamp(_col(c)).cast("date")
