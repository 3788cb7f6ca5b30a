"""Slot keys: half-hour index inside a local day, elapsed slot index, clock labels.

A slot is addressed by ``(settlement_date, settlement_period)``; the period
counts half hours from local midnight, so a clock-change day has 46 or 50.
``slot_ix`` counts elapsed half hours since the epoch in UTC: it never
collides on long days and ``slot_ix - 48`` is always 24 hours earlier.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "Europe/London"
SLOTS_PER_DAY = 48


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0))


def local_midnight_utc(date: str | Column, zone: str = DEFAULT_ZONE) -> Column:
    """UTC wall clock (no zone) of local midnight; independent of the session zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), col(date).cast("timestamp_ntz"))


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def slot_index(date="settlement_date", period="settlement_period", zone: str = DEFAULT_ZONE) -> Column:
    minutes = F.timestamp_diff("MINUTE", _epoch(), local_midnight_utc(date, zone))
    return (F.floor(minutes / 30) + col(period) - 1).cast("long")


def day_index(date="settlement_date") -> Column:
    return F.datediff(col(date), F.lit("1970-01-01").cast("date")).cast("long")


def slot_start(date="settlement_date", period="settlement_period") -> Column:
    """Naive clock time of the slot on a regular day."""
    return col(date).cast("timestamp_ntz") + F.make_dt_interval(mins=(col(period) - 1) * 30)


def wall_period(ts: str | Column) -> Column:
    """Period read off the wall clock of a timestamp (regular days)."""
    return (F.hour(col(ts)) * 2 + F.floor(F.minute(col(ts)) / 30) + 1).cast("int")


def local_clock(utc_ts: str | Column, zone: str = DEFAULT_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(utc_ts).cast("timestamp_ntz"))


def local_date(utc_ts: str | Column, zone: str = DEFAULT_ZONE) -> Column:
    return local_clock(utc_ts, zone).cast("date")


def ordinal_period(utc_ts: str | Column, zone: str = DEFAULT_ZONE) -> Column:
    """Half hours elapsed since local midnight, plus one: 1..46, 1..48 or 1..50."""
    start = local_midnight_utc(local_date(utc_ts, zone), zone)
    minutes = F.timestamp_diff("MINUTE", start, col(utc_ts).cast("timestamp_ntz"))
    return (F.floor(minutes / 30) + 1).cast("int")


def periods_in_day(date="settlement_date", zone: str = DEFAULT_ZONE) -> Column:
    a = local_midnight_utc(date, zone)
    b = local_midnight_utc(F.date_add(col(date), 1), zone)
    return F.floor(F.timestamp_diff("MINUTE", a, b) / 30).cast("int")


def clock_label(period="settlement_period") -> Column:
    return F.concat(
        F.lpad(F.floor((col(period) - 1) / 2).cast("string"), 2, "0"),
        F.when((col(period) - 1) % 2 == 0, F.lit(":00")).otherwise(F.lit(":30")),
    )


def ahead_date(date: str | Column, period: str | Column, h: str | Column) -> Column:
    """Date of the slot ``h`` half hours after ``(date, period)`` on regular days."""
    return F.date_add(col(date), F.floor((col(period) + col(h) - 1) / SLOTS_PER_DAY).cast("int"))


def ahead_period(period: str | Column, h: str | Column) -> Column:
    return (F.pmod(col(period) + col(h) - 1, F.lit(SLOTS_PER_DAY)) + 1).cast("int")
