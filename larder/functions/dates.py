"""Dates and times as column expressions; all times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of report time zones.
ZONES = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles", "EST": "America/New_York", "EDT": "America/New_York", "CST": "America/Chicago", "CDT": "America/Chicago", "MST": "America/Denver", "MDT": "America/Denver", "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles", "UTC": "UTC", "GMT": "UTC"}
#: Thresholds of a significant change, in percent, by months that have gone.
SIGNIFICANT = {1: 5.0, 3: 7.5, 6: 10.0}


def completed_years(birth: Column, on: Column) -> Column:
    """Age: a birthday on 29 February counts from 1 March in other years."""
    before = F.struct(F.month(on), F.dayofmonth(on)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(on) - F.year(birth) - before.cast("int")


def parse_date(text: Column, formats: tuple[str, ...] = ("MM/dd/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd")) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))


def parse_time(text: Column, formats: tuple[str, ...] = ("h:mm a", "h:mm:ss a", "HH:mm", "HH:mm:ss")) -> Column:
    """Seconds of the day of a 12 or 24 hour clock."""
    got = F.coalesce(*(F.try_to_timestamp(F.upper(text), F.lit(f)) for f in formats))
    return F.hour(got) * 3600 + F.minute(got) * 60 + F.second(got)


def zoned(local: Column, zone: Column) -> Column:
    """A local report time as UTC; null for a zone that is not known."""
    out = F.lit(None).cast("timestamp")
    for name, region in ZONES.items():
        out = F.when(zone == name, F.to_utc_timestamp(local, region)).otherwise(out)
    return out


def twelve_hour(hour: Column, afternoon: Column) -> Column:
    return F.pmod(hour, F.lit(12)) + F.when(afternoon, 12).otherwise(0)


def midnight(day: Column) -> Column:
    return day.cast("date").cast("timestamp")


def range_end(text: Column, pattern: str = r"(\d{1,2}/\d{1,2}/\d{4})(?:\s*-\s*(\d{1,2}/\d{1,2}/\d{4}))?") -> Column:
    """The end of a report's range of days, or its one day."""
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return parse_date(F.coalesce(part(2), part(1)), ("M/d/yyyy",))


def change_window(latest: Column, previous: Column) -> Column:
    """1, 3 or 6: the months within which the later day lies, by calendar months with the day clamped to the month's end; null beyond six or not later."""
    out = F.when(previous >= latest, None)
    for months in SIGNIFICANT:
        out = out.when(latest <= F.add_months(previous, months), months)
    return out


def significant(window: Column, percent: Column) -> Column:
    """Is a change, in either direction, at least its window's threshold?"""
    out = F.lit(False)
    for months, least in SIGNIFICANT.items():
        out = F.when(window == months, F.abs(percent) >= least).otherwise(out)
    return F.coalesce(out, F.lit(False))


def elapsed_months(latest: Column, previous: Column) -> Column:
    """Whole calendar months and the share of the one under way, rounded half up."""
    months = (F.year(latest) - F.year(previous)) * 12 + F.month(latest) - F.month(previous)
    months = F.when(F.add_months(previous, months) > latest, months - 1).otherwise(months)
    at, after = F.add_months(previous, months), F.add_months(previous, months + 1)
    return F.floor(months + F.datediff(latest, at) / F.datediff(after, at) + 0.5)


def elapsed_label(latest: Column, previous: Column) -> Column:
    n = elapsed_months(latest, previous)
    return F.when(previous >= latest, None).when(n < 1, "<1 month").when(n == 1, "1 month").otherwise(F.concat(n.cast("string"), F.lit(" months")))
