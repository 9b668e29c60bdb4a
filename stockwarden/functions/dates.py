"""Column expressions over dates, decimal hours and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_hours(hours: Column) -> Column:
    """8.5 -> 08:30 as an interval; only (0, 48] is an hour of the clock."""
    seconds = F.when((hours > 0) & (hours <= 48), hours * 3600)
    whole = F.floor(seconds).cast("int")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), whole.cast("decimal(18,6)"))


def real_timestamp(surgery_day: Column, start_hour: Column, start_ts: Column, registered: Column) -> Column:
    """Surgery day plus the decimal start hour, else the full start time, else the day alone."""
    base = F.coalesce(surgery_day, registered)
    return F.coalesce(base + decimal_hours(start_hour), F.when(base.isNotNull(), start_ts), base, start_ts)


def duration_minutes(start_hour: Column, end_hour: Column, start_ts: Column, end_ts: Column, stored: Column) -> Column:
    """Decimal hours wrapping midnight, else the two full times, else the stored value; valid in (0, 1440)."""
    wrapped = F.pmod((end_hour - start_hour) * 60.0, F.lit(1440.0))
    by_hours = F.when((start_hour > 0) & (end_hour > 0) & (wrapped > 0) & (wrapped < 1440), wrapped)
    spent = F.timestamp_diff("SECOND", start_ts, end_ts) / 60.0
    by_times = F.when((spent > 0) & (spent < 1440), spent)
    return F.coalesce(by_hours, by_times, stored)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_ending_sunday(ts: Column) -> Column:
    day = ts.cast("date")
    return F.date_add(day, F.lit(6) - F.weekday(day))


def day_count(start: Column, end: Column) -> Column:
    """Whole days from start to end."""
    return F.datediff(end.cast("date"), start.cast("date"))
