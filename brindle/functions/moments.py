"""Dates, times and timestamps from and to their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000


def _col(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x


def days_from_civil(year: Column | int, month: Column | int, day: Column | int) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.make_date(_col(year), _col(month), _col(day)))


def civil_from_days(days: Column | str) -> Column:
    """``struct<year, month, day>``."""
    date = F.date_from_unix_date(_col(days).cast("int"))
    return F.struct(F.year(date).alias("year"), F.month(date).alias("month"), F.day(date).alias("day"))


def micros_since_midnight(hour: Column | int, minute: Column | int, second: Column | int, fraction: Column | int) -> Column:
    """Microseconds of a time; the fraction is in steps of 100 ns and cut."""
    h, m, s, f = (_col(x).cast("bigint") for x in (hour, minute, second, fraction))
    return ((h * 60 + m) * 60 + s) * 1_000_000 + F.floor(f / 10)


def time_parts(nanos: Column | str) -> Column:
    """``struct<hour, minute, second, fraction>`` of nanoseconds since midnight; the fraction is in steps of 100 ns."""
    steps = F.floor(_col(nanos) / 100).cast("bigint")
    seconds = F.floor(steps / 10_000_000)
    return F.struct(*(x.cast("int").alias(n) for n, x in (("hour", F.floor(seconds / 3600)), ("minute", F.floor(seconds / 60) % 60), ("second", seconds % 60), ("fraction", steps % 10_000_000))))


def timestamp_from_parts(year, month, day, hour, minute, second, nanos) -> Column:
    """A timestamp without zone; nanoseconds are cut to microseconds."""
    micros = days_from_civil(year, month, day).cast("bigint") * _DAY + micros_since_midnight(hour, minute, second, 0) + F.floor(_col(nanos) / 1000)
    return timestamp_from_micros(micros)


def timestamp_from_micros(micros: Column | str) -> Column:
    """A timestamp without zone from microseconds since the epoch; doesn't depend on the session's zone."""
    day = F.floor(_col(micros) / _DAY)
    rest = F.pmod(_col(micros), F.lit(_DAY))
    return F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (rest.cast("decimal(18,6)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def timestamp_parts(ts: Column | str) -> Column:
    """``struct<year, month, day, hour, minute, second, micros>``; before the epoch too."""
    t = _col(ts)
    second = F.date_part(F.lit("SECOND"), t)
    fields = (("year", F.year(t)), ("month", F.month(t)), ("day", F.day(t)), ("hour", F.hour(t)), ("minute", F.minute(t)), ("second", F.floor(second)), ("micros", (second - F.floor(second)) * 1_000_000))
    return F.struct(*(x.cast("int").alias(n) for n, x in fields))
