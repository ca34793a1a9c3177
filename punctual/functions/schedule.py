"""Scheduled times: service-day text to epoch seconds, midnight rollover, delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
LOCAL_TO_UTC_S = -3_600  # fixed value: the schedule is local winter time


def utc_seconds(naive: Column) -> Column:
    """Epoch seconds of a timestamp without zone, read as UTC whatever the session's zone is."""
    return F.unix_seconds(F.from_utc_timestamp(naive.cast("timestamp"), F.current_timezone()))


def day_seconds(texts: Column) -> Column:
    """Array of ``HH:MM:SS`` to seconds of the service day; null for malformed text."""
    parts = F.transform(texts, lambda x: F.split(x, ":"))

    def number(p: Column, i: int) -> Column:
        return F.get(p, F.lit(i)).try_cast("int")

    return F.transform(
        parts, lambda p: F.when(F.size(p) == 3, number(p, 0) * 3600 + number(p, 1) * 60 + number(p, 2))
    )


def is_plain_day(seconds: Column) -> Column:
    """All arrivals are well-formed and before 24:00:00 of the service day."""
    return F.forall(seconds, lambda s: F.coalesce(s < DAY, F.lit(False)))


def event_day(timestamp: Column) -> Column:
    """Days since the epoch of the event's UTC date."""
    return F.floor(timestamp / DAY).cast("int")


def rollover_index(seconds: Column) -> Column:
    """Index of the last stop whose time is below that of the stop before it, 0 if there is none."""
    descents = F.transform(
        seconds, lambda x, i: F.when((i > 0) & (x < F.get(seconds, i - 1)), i).otherwise(F.lit(0))
    )
    return F.coalesce(F.array_max(descents), F.lit(0))


def resolve(seconds: Column, day: Column, rollover: Column, offset_s: int = LOCAL_TO_UTC_S) -> Column:
    """Epoch seconds per stop: stops before the rollover index belong to the previous day."""
    midnight = day.cast("bigint") * DAY
    return F.transform(
        seconds, lambda x, i: midnight + x + F.when(i < rollover, -DAY).otherwise(0) + F.lit(offset_s)
    )


def resolve_in_zone(seconds: Column, day: Column, rollover: Column, zone: str) -> Column:
    """As ``resolve``, reading the schedule as wall-clock time of a named zone."""
    local = resolve(seconds, day, rollover, 0)
    return F.transform(
        local, lambda x: F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(x), zone))
    )
