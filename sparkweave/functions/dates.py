"""Date functions on columns; null dates give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(day: Column) -> Column:
    """Months counted from 0, January, to 11."""
    return (F.month(day) - 1).cast("int")


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def days_left_in_month(day: Column) -> Column:
    """0 on a month's last day."""
    return F.datediff(F.last_day(day), day)


def months_since(day: Column, year: int, month: int = 1, most: int = 12) -> Column:
    """Months from the given month, the first counting as 1, held between 1 and most."""
    n = (F.year(day) - F.lit(year)) * 12 + F.month(day) - F.lit(month) + 1
    return F.when(day.isNotNull(), F.greatest(F.lit(1), F.least(n, F.lit(most))))
