"""Date and time column expressions; the session time zone is UTC and "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends in minutes, and labels, of the flight duration histogram; fixed values.
DURATION_BUCKETS = [
    (5, "0-5min"), (10, "5-10min"), (15, "10-15min"), (30, "15-30min"), (60, "30-60min"), (90, "60-90min"),
    (120, "90-120min"), (150, "120-150min"), (180, "150-180min"), (210, "180-210min"), (240, "210-240min"),
    (270, "240-270min"), (300, "270-300min"), (330, "300-330min"), (360, "330-360min"), (None, "360+min"),
]


def half_up(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, rounded; null where a bound is."""
    return half_up((F.unix_micros(end) - F.unix_micros(start)) / 1e6)


def flight_seconds(takeoff: Column, landing: Column) -> Column:
    """0 where a bound is missing."""
    return F.coalesce(seconds_between(takeoff, landing), F.lit(0).cast("long"))


def duration_bucket(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    out = F.lit(DURATION_BUCKETS[-1][1])
    for most, label in reversed(DURATION_BUCKETS[:-1]):
        out = F.when(minutes < most, label).otherwise(out)
    return out


def flight_state(landing: Column, timed_out: Column, last_fix: Column, as_of: Column) -> Column:
    """timed_out, complete, stale (10 minutes without a fix) or active."""
    quiet = F.unix_micros(as_of) - F.unix_micros(last_fix) > 10 * 60 * 1_000_000
    return (
        F.when(timed_out.isNotNull(), "timed_out").when(landing.isNotNull(), "complete").when(quiet, "stale").otherwise("active")
    )


def within_days(ts: Column, as_of: Column, days: int) -> Column:
    """From midnight so many days before."""
    return F.coalesce(ts >= F.date_sub(F.to_date(as_of), days).cast("timestamp"), F.lit(False))


def within_hours(ts: Column, as_of: Column, hours: Column | int) -> Column:
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    return ts >= as_of - F.make_interval(hours=hours)


def on_day(ts: Column, day: Column) -> Column:
    """The half-open UTC day."""
    return (ts >= day.cast("timestamp")) & (ts < F.date_add(day, 1).cast("timestamp"))


def hours_between(first: Column, last: Column) -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / 3.6e9
