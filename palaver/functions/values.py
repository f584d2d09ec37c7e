"""Numbers and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.fixed import WEEKDAYS


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0 when the whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(share: Column, digits: int) -> Column:
    """A share as a rounded percentage, for display."""
    return F.round(share * 100, digits)


def utc_from_epoch(seconds: Column) -> Column:
    """Epoch seconds to a UTC wall-clock timestamp, whatever the session zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return origin + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def utc_from_instant(instant: Column) -> Column:
    """A zoned timestamp to its UTC wall-clock time, whatever the session zone."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return utc_from_epoch(seconds)


def month_key(timestamp: Column) -> Column:
    """``yyyy-MM`` of a UTC wall-clock timestamp, whatever the session zone."""
    return F.date_format(timestamp.cast("date"), "yyyy-MM")


def weekday_name(number: Column) -> Column:
    """English name of a weekday number, Monday being 0."""
    names = F.array(*[F.lit(day) for day in WEEKDAYS])
    return F.element_at(names, number + 1)


def epoch_seconds(timestamp: Column) -> Column:
    """UTC wall-clock timestamp to epoch seconds, the inverse of ``utc_from_epoch``."""
    elapsed = timestamp - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days, hours, minutes, seconds = [
        F.extract(F.lit(unit), elapsed).cast("double")
        for unit in ("DAY", "HOUR", "MINUTE", "SECOND")
    ]
    return days * 86400 + hours * 3600 + minutes * 60 + seconds
