"""Instants and calendar keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)(Z|([+-][0-9]{2}):?([0-9]{2})?)?$"


def instant(text: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 date and time (no offset: UTC) or of milliseconds as digits; null if unreadable."""
    zone = F.when(F.regexp_extract(text, ISO, 4) == "", "Z").otherwise(
        F.concat(F.regexp_extract(text, ISO, 4), F.lit(":"), F.when(F.regexp_extract(text, ISO, 5) == "", "00").otherwise(F.regexp_extract(text, ISO, 5)))
    )
    clock = F.regexp_extract(text, ISO, 2)
    clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    full = F.concat(F.regexp_extract(text, ISO, 1), F.lit("T"), clock, zone)
    return F.when(text.rlike("^[0-9]{1,15}$"), text.try_cast("bigint") * 1000).when(text.rlike(ISO), F.unix_micros(full.try_cast("timestamp")))


def micros(stamp: Column) -> Column:
    """Microseconds of a timestamp, with or without zone (then UTC)."""
    return F.unix_micros(stamp.cast("timestamp"))


def period_key(stamp: Column, period: str) -> Column:
    """Calendar key of a UTC time: 2024-03-01, 2024-W09 (calendar year and ISO week), or 2024-03."""
    if period == "day":
        return F.date_format(stamp, "yyyy-MM-dd")
    if period == "week":
        return F.format_string("%04d-W%02d", F.year(stamp), F.weekofyear(stamp))
    if period == "month":
        return F.date_format(stamp, "yyyy-MM")
    raise ValueError(f"period {period!r}: day, week or month")
