"""Amounts, durations and rates as Columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIXES = (("k", "kilo", "kibi"), ("m", "mega", "mebi"), ("g", "giga", "gibi"), ("t", "tera", "tebi"), ("p", "peta", "pebi"))
DATA_UNITS: dict[str, float] = dict.fromkeys(("b", "byte", "bytes"), 1.0) | dict.fromkeys(("bit", "bits"), 1 / 8)
for _power, (_letter, _ten, _two) in enumerate(_PREFIXES, 1):
    DATA_UNITS |= dict.fromkeys((f"{_letter}b", f"{_letter}ib", *(f"{p}byte{s}" for p in (_ten, _two) for s in ("", "s"))), 1024.0**_power)
    DATA_UNITS |= dict.fromkeys((f"{_letter}bit", f"{_letter}bits", f"{_ten}bit", f"{_ten}bits"), 1024.0**_power / 8)
#: Seconds as (numerator, denominator), so that parts of a second are divided exactly once.
TIME_UNITS: dict[str, tuple[float, float]] = (
    dict.fromkeys(("s", "sec", "secs", "second", "seconds"), (1.0, 1.0))
    | dict.fromkeys(("ms", "millisecond", "milliseconds"), (1.0, 1e3))
    | dict.fromkeys(("us", "microsecond", "microseconds", "µs"), (1.0, 1e6))
    | dict.fromkeys(("ns", "nanosecond", "nanoseconds"), (1.0, 1e9))
    | dict.fromkeys(("m", "min", "mins", "minute", "minutes"), (60.0, 1.0))
    | dict.fromkeys(("h", "hr", "hrs", "hour", "hours"), (3600.0, 1.0))
)
RATE_UNITS = ("B/s", "KB/s", "MB/s", "GB/s", "TB/s", "PB/s")


def _unit(unit: Column | str) -> Column:
    return F.lower(F.lit(unit) if isinstance(unit, str) else unit)


def _number(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def _by_unit(unit: Column | str, choices: dict, what: str) -> Column:
    """One of the expressions by a unit's name; null for a null unit, an error for an unknown one."""
    name = _unit(unit)
    groups: dict = {}
    for spelling, value in choices.items():
        groups.setdefault(value, []).append(spelling)
    chain = F.when(name.isNull(), F.lit(None).cast("double"))
    for value, spellings in groups.items():
        chain = chain.when(name.isin(spellings), F.lit(value))
    return chain.otherwise(F.raise_error(F.concat(F.lit(f"unsupported {what} unit: "), name)).cast("double"))


def to_bytes(quantity: Column | float, unit: Column | str) -> Column:
    """An amount of data in bytes. Prefixes step by 1024, whatever their spelling, and case doesn't matter."""
    return _number(quantity) * _by_unit(unit, DATA_UNITS, "data")


def to_seconds(duration: Column | float, unit: Column | str) -> Column:
    """A duration in seconds."""
    up = _by_unit(unit, {k: v[0] for k, v in TIME_UNITS.items()}, "time")
    down = _by_unit(unit, {k: v[1] for k, v in TIME_UNITS.items()}, "time")
    return _number(duration) * up / down


def fixed(x: Column, precision: int) -> Column:
    """A number with ``precision`` decimals, rounded by its exact binary value, and no thousands separators."""
    return F.call_function("format_number", x, F.lit("0." + "0" * precision if precision else "0"))


def format_bytes_per_second(rate: Column | float, precision: int = 2) -> Column:
    """A rate in the largest unit that leaves at least one, as in ``3.33 MB/s``."""
    x = _number(rate)
    size = F.abs(x)
    last = len(RATE_UNITS) - 1
    scaled = [F.concat(fixed(x / F.lit(1024.0**k), precision), F.lit(f" {u}")) for k, u in enumerate(RATE_UNITS)]
    chain = functools.reduce(lambda c, k: c.when(size < 1024.0 ** (k + 1), scaled[k]), range(1, last), F.when(size < 1024.0, scaled[0]))
    return chain.otherwise(scaled[last])


def calculate_rate(quantity: Column | float, quantity_unit: Column | str, duration: Column | float, duration_unit: Column | str, precision: int = 2) -> Column:
    """Amount over duration, formatted. A duration that isn't positive, or an unknown unit, is an error."""
    span = _number(duration)
    checked = F.when(span <= 0, F.raise_error(F.lit("duration must be positive")).cast("double")).otherwise(span)
    return format_bytes_per_second(to_bytes(quantity, quantity_unit) / to_seconds(checked, duration_unit), precision)
