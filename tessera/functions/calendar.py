"""Calendar expressions: weekdays with Monday as 0, weeks that end on Sunday, spines of dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_of_week(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(day)


def week_ending(day: Column) -> Column:
    """The Sunday that ends the week of `day`."""
    return F.date_add(F.date_trunc("week", day).cast("date"), 6)


def first_monday(day: Column) -> Column:
    """`day` if it is a Monday, else the next one."""
    return F.date_add(day, F.pmod(F.lit(7) - F.weekday(day), F.lit(7)))


def last_sunday(day: Column) -> Column:
    """`day` if it is a Sunday, else the one before."""
    return F.date_sub(day, F.pmod(F.weekday(day) + 1, F.lit(7)))


def spine(first: Column, last: Column, step_days: int = 1) -> Column:
    """One row for each date from first to last."""
    return F.explode(F.sequence(first, last, F.make_dt_interval(F.lit(step_days))))
