"""Dates, ages and weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewright.functions.numeric import _col, clamp


def micros(ts) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def hours_between(a, b) -> Column:
    return (micros(b) - micros(a)) / 3.6e9


def days_between(a, b) -> Column:
    return (micros(b) - micros(a)) / 8.64e10


def kickoff_or_default(commence, date, hhmmss: str) -> Column:
    """Start time, or the given time of day where it is unknown."""
    h, m, s = (int(x) for x in hhmmss.split(":"))
    default = _col(date).cast("timestamp_ntz") + F.expr(f"INTERVAL '{h:02d}:{m:02d}:{s:02d}' HOUR TO SECOND")
    return F.coalesce(_col(commence), default)


def season_label(date) -> Column:
    y = F.year(_col(date)) - F.when(F.month(_col(date)) >= 7, 0).otherwise(1)
    return F.format_string("%d-%02d", y, (y + 1) % 100)


def days_before(quote_ts, kickoff) -> Column:
    return F.greatest(F.lit(0), F.floor(days_between(quote_ts, kickoff) + 0.5)).cast("int")


def proximity(days, scale: float) -> Column:
    return 1.0 / (1.0 + F.greatest(F.lit(0.0), _col(days)) / scale)


def half_life(age, days: float) -> Column:
    return F.pow(F.lit(0.5), _col(age) / days)


def fade(days, over: float) -> Column:
    return clamp((_col(days) - 1.0) / over, 0.0, 1.0)


def days_until(now, ts) -> Column:
    return F.greatest(F.lit(0), F.ceil(days_between(now, ts))).cast("int")
