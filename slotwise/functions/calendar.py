"""Calendar parts, cyclic encodings, flags and the England bank-holiday table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.keys import col


def cyclic(value: Column, period: float, prefix: str) -> dict[str, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return {f"sin_{prefix}": F.sin(angle), f"cos_{prefix}": F.cos(angle)}


def calendar_parts(date="settlement_date", period="settlement_period") -> dict[str, Column]:
    d = col(date)
    return {
        "hour": F.floor((col(period) - 1) / 2).cast("int"),
        "day_of_week": F.weekday(d),
        "month": F.month(d),
        "week_of_year": F.weekofyear(d),
        "quarter": F.quarter(d),
        "day_of_year": F.dayofyear(d),
    }


def calendar_cycles(date="settlement_date", period="settlement_period") -> dict[str, Column]:
    """One phase convention everywhere: the first slot, hour, weekday and month sit at angle 0."""
    d, p = col(date), col(period)
    out: dict[str, Column] = {}
    out |= cyclic(p - 1, 48, "sp")
    out |= cyclic(F.floor((p - 1) / 2), 24, "hour")
    out |= cyclic(F.weekday(d), 7, "dow")
    out |= cyclic(F.month(d) - 1, 12, "month")
    out |= cyclic(F.month(d) - 1, 6, "half_year")
    return out


def calendar_flags(date="settlement_date", period="settlement_period") -> dict[str, Column]:
    return {
        "is_weekend": (F.weekday(col(date)) >= 5).cast("int"),
        "is_peak": col(period).between(13, 36).cast("int"),
        "is_evening_peak": col(period).between(33, 40).cast("int"),
    }


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous computus, in column arithmetic."""

    def div(a, b):
        return F.floor(a / b)

    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    el = (32 + 2 * e + 2 * i - h - k) % 7
    m = div(a + 11 * h + 22 * el, 451)
    s = h + el - 7 * m + 114
    return F.make_date(year.cast("int"), div(s, 31).cast("int"), (s % 31 + 1).cast("int"))


def bank_holidays(dates: DataFrame, date: str = "settlement_date") -> DataFrame:
    """England and Wales bank holidays by rule for every year that ``date`` holds; one row per holiday (about 8 per year)."""
    y = F.col("year").cast("int")

    def first_monday(month: int) -> Column:
        return F.next_day(F.date_sub(F.make_date(y, F.lit(month), F.lit(1)), 1), "Mon")

    def last_monday(month: int) -> Column:
        return F.date_sub(F.next_day(F.last_day(F.make_date(y, F.lit(month), F.lit(1))), "Mon"), 7)

    def weekend_moved(d: Column) -> Column:
        return F.when(F.weekday(d) == 5, F.date_add(d, 2)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)

    easter = easter_sunday(F.col("year"))
    xmas = F.make_date(y, F.lit(12), F.lit(25))
    boxing = F.make_date(y, F.lit(12), F.lit(26))
    # Holidays moved or added by proclamation.
    early_may = (
        F.when(y == 1995, F.lit("1995-05-08").cast("date"))
        .when(y == 2020, F.lit("2020-05-08").cast("date"))
        .otherwise(first_monday(5))
    )
    spring = (
        F.when(y == 2002, F.lit("2002-06-04").cast("date"))
        .when(y == 2012, F.lit("2012-06-04").cast("date"))
        .when(y == 2022, F.lit("2022-06-02").cast("date"))
        .otherwise(last_monday(5))
    )
    one_off = [
        "1999-12-31", "2002-06-03", "2011-04-29", "2012-06-05", "2022-06-03", "2022-09-19", "2023-05-08",
    ]
    # A weekend holiday counts on its own date and on its substitute weekday.
    regular = F.array(
        F.make_date(y, F.lit(1), F.lit(1)),
        xmas,
        boxing,
        weekend_moved(F.make_date(y, F.lit(1), F.lit(1))),
        F.date_sub(easter, 2),
        F.date_add(easter, 1),
        early_may,
        spring,
        last_monday(8),
        weekend_moved(xmas),
        # Boxing Day substitutes follow the Christmas substitute.
        F.when(F.weekday(boxing).isin(5, 6), F.date_add(boxing, 2))
        .when(F.weekday(boxing) == 0, F.date_add(boxing, 1))
        .otherwise(boxing),
    )
    years = dates.select(F.year(date).alias("year")).where("year IS NOT NULL").distinct()
    special = F.array(*[F.lit(x).cast("date") for x in one_off])
    return (
        years.select(F.explode(F.concat(regular, F.filter(special, lambda s: F.year(s) == y))).alias("holiday_date"))
        .distinct()
    )
