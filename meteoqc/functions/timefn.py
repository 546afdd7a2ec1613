"""Calendar, rounding and parsing of timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 60_000_000.0


def round_to_minutes(ts: Column | str, minutes: int) -> Column:
    """Nearest multiple, halves to the even multiple."""
    step = minutes * 60_000_000
    nearest = F.bround(F.unix_micros(ts) / float(step), 0).cast("long")
    return F.timestamp_micros(nearest * F.lit(step))


def calendar(ts: str = "obs_ts") -> dict[str, Column]:
    hour, minute = F.hour(ts), F.minute(ts)
    doy, dow = F.dayofyear(ts), F.weekday(ts)
    turn = 2.0 * math.pi
    day = turn * (hour + minute / 60.0) / 24.0
    year = turn * (doy - 1) / 365.25
    week = turn * dow / 7.0
    return {
        "hour": hour, "minute": minute, "day_of_year": doy, "month": F.month(ts), "day_of_week": dow,
        "sin_hour": F.sin(day), "cos_hour": F.cos(day),
        "sin_day_of_year": F.sin(year), "cos_day_of_year": F.cos(year),
        "sin_day_of_week": F.sin(week), "cos_day_of_week": F.cos(week),
    }


def parse_timestamp(text: Column | str) -> Column:
    """ISO text with or without zone (no zone = UTC session), or epoch seconds; bad text = null."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    epoch = F.when(t.rlike(r"^-?\d{9,11}(\.\d+)?$"), F.timestamp_micros((t.try_cast("double") * 1e6).cast("long")))
    return F.coalesce(epoch, F.try_to_timestamp(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})T", "$1 ")))
