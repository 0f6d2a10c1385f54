"""Times in UTC; `now` is always an argument, so that results repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_z(at: Column) -> Column:
    """ISO-8601 to the second, with Z; the session's zone is to be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_seconds(now) - F.unix_seconds(at)) / 86400


def expired(at: Column, now: Column, days: int) -> Column:
    return at < now - F.make_dt_interval(F.lit(days))
