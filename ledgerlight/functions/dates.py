"""Dates and states that depend on them. The time "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_datetime(c: Column) -> Column:
    """An ISO text as a time in the session's zone (UTC); NULL if it is none."""
    return F.try_to_timestamp(c)


def written_date(c: Column) -> Column:
    """The calendar date as written, ISO or ``dd/MM/yyyy``, without any zone shift."""
    text = F.trim(c)
    iso = F.try_to_date(F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    local = F.try_to_date(F.regexp_extract(text, r"^([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), "dd/MM/yyyy")
    return F.coalesce(iso, local)


def elapsed_days(start: Column, end: Column) -> Column:
    """D3: whole periods of 24 hours."""
    return F.timestamp_diff("DAY", start, end)


def week_start(c: Column) -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", c).cast("date")


def day_bounds_utc(day: Column, zone: str = "Europe/Madrid") -> tuple[Column, Column]:
    """A local day's first instant and the next day's, in UTC."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def price_state(at: Column, now: Column, days: int = 7) -> Column:
    """Current up to ``days``, last-known up to twice that, else expired; a future time is expired."""
    age = now - at
    return (
        F.when(at.isNull() | (at > now), "expired")
        .when(age <= F.expr(f"INTERVAL {days} DAYS"), "current")
        .when(age <= F.expr(f"INTERVAL {2 * days} DAYS"), "last_known")
        .otherwise("expired")
    )


def check_time(captured: Column, last_ok: Column, now: Column) -> Column:
    """A later check counts only if it isn't before the capture nor in the future."""
    return F.when((last_ok >= captured) & (last_ok <= now), last_ok).otherwise(captured)


def scheduler_state(heartbeat: Column, stopped: Column, now: Column, interval_seconds: int = 300) -> Column:
    """Never, stopped, stale (no sign for two intervals and five minutes) or running."""
    late = now - heartbeat > F.expr(f"INTERVAL {2 * interval_seconds + 300} SECONDS")
    return F.when(heartbeat.isNull(), "never").when(stopped, "stopped").when(late, "stale").otherwise("running")
