"""Calendar arithmetic as Column expressions (CA1-CA3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

MONDAY, FRIDAY, SATURDAY = 0, 4, 5


def month_start(year: Column | str, month: Column | int) -> Column:
    return F.make_date(col(year), month if isinstance(month, Column) else F.lit(month), F.lit(1))


def nth_weekday(first_of_month: Column, weekday: int, n: int) -> Column:
    """n-th (1-based) weekday (Monday = 0) of the month starting at the given date."""
    offset = F.pmod(F.lit(weekday) - F.weekday(first_of_month), F.lit(7))
    return F.date_add(first_of_month, (offset + 7 * (n - 1)).cast("int"))


def third_friday(first_of_month: Column) -> Column:
    return nth_weekday(first_of_month, FRIDAY, 3)


def first_friday(first_of_month: Column) -> Column:
    return nth_weekday(first_of_month, FRIDAY, 1)


def last_business_day(any_day: Column) -> Column:
    end = F.last_day(any_day)
    return F.date_sub(end, F.greatest(F.weekday(end) - FRIDAY, F.lit(0)))


def first_business_day(first_of_month: Column) -> Column:
    wd = F.weekday(first_of_month)
    return F.date_add(first_of_month, F.when(wd >= SATURDAY, F.lit(7) - wd).otherwise(0))


def business_days_before(day: Column, n: Column | int) -> Column:
    """The date ``n`` weekdays earlier, in closed form.

    A weekend day first counts as the Friday before it plus one step, then every
    five weekdays span seven days.
    """
    steps = n if isinstance(n, Column) else F.lit(n)
    wd = F.weekday(day)
    weekend = F.greatest(wd - FRIDAY, F.lit(0))
    anchor = F.date_sub(day, F.when(steps > 0, weekend).otherwise(0))
    left = F.when((weekend > 0) & (steps > 0), steps - 1).otherwise(steps)
    weeks = F.floor(left / 5).cast("int")
    rest = F.pmod(left, F.lit(5)).cast("int")
    skip = F.when(rest > F.weekday(anchor), 2).otherwise(0)
    return F.date_sub(anchor, (weeks * 7 + rest + skip).cast("int"))
