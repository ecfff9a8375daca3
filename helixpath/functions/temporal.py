"""Dates of partial precision, as texts: calendar arithmetic with Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A partial date or time: year, month, day, hour, minute, second, fraction, zone (fixed pattern).
PARTS = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(?:(\d{2})(?::(\d{2})(?::(\d{2})(\.\d+)?)?)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"
DATE_SHAPE = r"^\d{4}(-\d{2}(-\d{2})?)?$"
DATETIME_SHAPE = r"^\d{4}(-\d{2}(-\d{2}(T(\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"

#: Position of a unit among the parts, and how many seconds it has (fixed values; weeks are days).
UNITS = {"year": 1, "month": 2, "week": 3, "day": 3, "hour": 4, "minute": 5, "second": 6}
_SECONDS = {"week": 7 * 86400, "day": 86400, "hour": 3600, "minute": 60, "second": 1}


def _part(text: Column, n: int) -> Column:
    return F.regexp_extract(text, PARTS, n)


def precision(text: Column) -> Column:
    """How many of year, month, day, hour, minute, second are given; 0 where the text is no date."""
    return sum(((_part(text, n) != "").cast("int") for n in range(1, 7)), F.lit(0))


def add(text: Column, amount: Column, unit: str) -> Column:
    """``text`` plus a whole amount of ``unit``, to the same precision; null for a fraction of a unit or one finer than the text.

    A day beyond the month's last becomes its last. The zone and the second's fraction stay as written.
    """
    if unit not in UNITS:
        return F.lit(None).cast("string")
    n = amount.cast("long")
    digits = precision(text)
    full = F.concat(_part(text, 1), F.lit("-"), _or(text, 2, "01"), F.lit("-"), _or(text, 3, "01"))
    # a day that the month does not have counts as its last
    first = F.concat(_part(text, 1), F.lit("-"), _or(text, 2, "01"), F.lit("-01")).try_cast("date")
    day = F.least(_or(text, 3, "01").try_cast("int"), F.dayofmonth(F.last_day(first)))
    date = F.coalesce(full.try_cast("date"), F.date_add(first, day - 1))
    seconds = _clock(text)
    if unit in ("year", "month"):
        moved = F.add_months(date, (n * (12 if unit == "year" else 1)).cast("int"))
    else:
        seconds = seconds + n * _SECONDS[unit]
        moved = F.date_add(date, F.floor(seconds / 86400).cast("int"))
        seconds = F.pmod(seconds, F.lit(86400))
    out = F.when(digits == 1, F.date_format(moved, "yyyy")).when(digits == 2, F.date_format(moved, "yyyy-MM")).otherwise(F.date_format(moved, "yyyy-MM-dd"))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    out = F.concat(
        out,
        F.when(F.contains(text, F.lit("T")), "T").otherwise(""),
        F.when(digits >= 4, two(F.floor(seconds / 3600))).otherwise(""),
        F.when(digits >= 5, F.concat(F.lit(":"), two(F.floor(seconds / 60) % 60))).otherwise(""),
        F.when(digits >= 6, F.concat(F.lit(":"), two(seconds % 60))).otherwise(""),
        _part(text, 7),
        _part(text, 8),
    )
    return F.when((amount == n) & (digits > 0) & (digits >= UNITS[unit]), out)


def _or(text: Column, n: int, default: str) -> Column:
    part = _part(text, n)
    return F.when(part == "", default).otherwise(part)


def _clock(text: Column) -> Column:
    hour, minute, second = (_or(text, n, "0").try_cast("long") for n in (4, 5, 6))
    return hour * 3600 + minute * 60 + second


def today() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")


def now() -> Column:
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
