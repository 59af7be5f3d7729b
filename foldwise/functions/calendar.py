"""Date parts and time differences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def date_parts(ts: Column) -> dict[str, Column]:
    """Day of week with Monday 0, month, day of year, hour."""
    return {
        "weekday": F.weekday(ts),
        "month": F.month(ts),
        "dayofyear": F.dayofyear(ts),
        "hour": F.hour(ts),
    }


def weekday_flag(ts: Column, as_is: bool = True) -> Column:
    """``as_is``: 0 for day numbers 1 to 5 with Monday 0, so Monday and Sunday give 1. Otherwise weekend gives 1."""
    day = F.weekday(ts)
    quiet = day.between(1, 5) if as_is else day.between(0, 4)
    return F.when(quiet, 0).otherwise(1)


def hour_bucket(hour: Column) -> Column:
    return F.when(hour <= 6, 0).when(hour <= 12, 1).when(hour <= 18, 2).otherwise(3)


def time_slot(ts: Column, minutes: int = 30) -> Column:
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / F.lit(minutes)).cast("int")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds; multiply by 1e9 for nanosecond consumers."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)
