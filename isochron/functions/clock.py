"""Schedule clock times and weekdays as Column expressions.

A schedule time counts seconds from the midnight of its service day and may pass
24 hours, so it is an integer, never a timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_IN_WEEK = 168


def parse_clock(text: Column) -> Column:
    """Seconds of ``H+:MM:SS`` (blanks around are ignored); null if it isn't three integers or the hours are negative."""
    parts = F.split(F.trim(text), ":")
    num = [F.trim(F.try_element_at(parts, F.lit(i + 1))).try_cast("int") for i in range(3)]
    good = (F.size(parts) == 3) & (num[0] >= 0)
    return F.when(good, num[0] * 3600 + num[1] * 60 + num[2])


def span_hours(first: Column, last: Column) -> Column:
    """Array of hour numbers (from service midnight) that [first, last) touches; one hour if last <= first."""
    h0 = F.floor(first / 3600).cast("int")
    h1 = F.when(last > first, F.floor((last - 1) / 3600).cast("int")).otherwise(h0)
    return F.sequence(h0, h1)


def hour_of_week(weekday: Column, hour: Column) -> Column:
    """Cell 0..167 (Monday first) of an hour counted from ``weekday``'s midnight; later days wrap over the week."""
    return F.pmod(weekday * 24 + hour, F.lit(HOURS_IN_WEEK)).cast("int")


def service_date_weekday(text: Column) -> Column:
    """Weekday (Monday 0) of a ``yyyyMMdd`` date; null if it isn't one."""
    d = F.try_to_timestamp(F.when(F.trim(text).rlike("^[0-9]{8}$"), F.trim(text)), F.lit("yyyyMMdd")).cast("date")
    return F.weekday(d)
