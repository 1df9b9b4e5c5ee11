"""Points in time and durations as Columns of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a point in time.
PARTS = {"y": F.year, "mo": F.month, "dd": F.dayofmonth, "h": F.hour, "mi": F.minute, "s": F.second}
#: Seconds of a duration's parts; a year has 365 days.
UNITS = {"years": 31_536_000, "days": 86_400, "hours": 3600, "minutes": 60, "seconds": 1}


def rounded(t: Column) -> Column:
    """To the next whole second, from half a second on."""
    return F.date_trunc("second", t + F.expr("interval 500 milliseconds"))


def split(t: Column) -> dict[str, Column]:
    return {k: f(t) for k, f in PARTS.items()}


def duration(seconds: Column) -> dict[str, Column]:
    """Each part of a number of seconds, after the larger ones were taken off."""
    out, left = {}, seconds.cast("long")
    for name, size in UNITS.items():
        out[name] = F.floor(left / size)
        left = left % size
    return out


def age(t: Column, now: Column) -> Column:
    """Whole seconds from t to now."""
    return F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(t.cast("timestamp"))
