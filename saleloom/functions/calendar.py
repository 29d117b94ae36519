"""Calendar columns of a date."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(d: Column) -> list[Column]:
    return [
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.quarter(d).alias("quarter"),
        F.weekday(d).alias("day_of_week"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofyear(d).alias("day_of_year"),
    ]


def flags(d: Column) -> list[Column]:
    next_day = F.date_add(d, 1)
    return [
        (F.weekday(d) >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(d) == 1).cast("int").alias("is_month_start"),
        (F.dayofmonth(next_day) == 1).cast("int").alias("is_month_end"),
        (F.trunc(d, "quarter") == d).cast("int").alias("is_quarter_start"),
        (F.trunc(next_day, "quarter") == next_day).cast("int").alias("is_quarter_end"),
    ]


def _wave(value: Column, period: int, name: str) -> list[Column]:
    angle = value * F.lit(2 * math.pi / period)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def cyclical(d: Column) -> list[Column]:
    return (_wave(F.month(d), 12, "month")
            + _wave(F.weekday(d), 7, "day_of_week")
            + _wave(F.dayofyear(d), 365, "day_of_year"))


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def days_of_month(d: Column) -> Column:
    """Array with every date of the month of ``d``."""
    first = F.trunc(d, "MM")
    return F.sequence(first, F.last_day(first))


def days_since(d: Column, start: str = "2014-01-01") -> Column:
    return F.datediff(d, F.lit(start).cast("date"))
