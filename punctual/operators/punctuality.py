"""Real against scheduled times: the flagship result, and schedules resolved for a given day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schedule as sch
from .runs import METRO


def day_plans(trips_nested: DataFrame, route_type: int | None = METRO) -> DataFrame:
    """Per trip with stops: clock seconds per stop, also of arrivals from hour 24 on, and the rollover index.

    A stop without a readable time has a null second, and so a null scheduled time.
    """
    chosen = F.col("stops").isNotNull()
    if route_type is not None:
        chosen = (F.col("route_type") == route_type) & chosen
    return (
        trips_nested.filter(chosen)
        .select(
            "trip_id",
            F.col("stops.stop_sequence").alias("sequences"),
            F.col("stops.stop_name").alias("names"),
            F.transform(sch.day_seconds(F.col("stops.arrival_time")), lambda s: s % sch.DAY).alias("seconds"),
        )
        .withColumn("rollover", sch.rollover_index(F.col("seconds")))
    )


def resolved_schedule(
    trip_days: DataFrame,
    trips_nested: DataFrame,
    route_type: int | None = None,
    offset_s: int = sch.LOCAL_TO_UTC_S,
    zone: str | None = None,
) -> DataFrame:
    """Scheduled epoch seconds of every stop for ``(trip_id, timestamp)``; one row per stop."""
    planned = trip_days.join(day_plans(trips_nested, route_type), "trip_id")
    day = sch.event_day(F.col("timestamp"))
    args = (F.col("seconds"), day, F.col("rollover"))
    times = sch.resolve(*args, offset_s) if zone is None else sch.resolve_in_zone(*args, zone)
    rows = F.explode(F.arrays_zip(times.alias("scheduled"), F.col("sequences").alias("stop_sequence")))
    return planned.select(*trip_days.columns, rows.alias("r")).select(
        *trip_days.columns, "r.stop_sequence", "r.scheduled"
    )


def arrival_delays(arrivals: DataFrame, trips_nested: DataFrame, offset_s: int = sch.LOCAL_TO_UTC_S) -> DataFrame:
    """Every first arrival with its stop, the scheduled time on the event's date, and the delay in seconds."""
    plans = day_plans(trips_nested)
    at = F.col("hit")
    scheduled = (
        sch.event_day(F.col("timestamp")).cast("bigint") * sch.DAY
        + F.get("seconds", at)
        - F.when(at < F.col("rollover"), sch.DAY).otherwise(0)
        + F.lit(offset_s)
    )
    return (
        arrivals.join(plans, "trip_id")
        .withColumn("scheduled", scheduled)
        .select(
            "id",
            "run",
            "trip_id",
            F.get("sequences", at).alias("stop_sequence"),
            F.get("names", at).alias("stop_name"),
            F.col("timestamp").alias("arrival"),
            "scheduled",
            (F.col("timestamp") - F.col("scheduled")).alias("delay_s"),
        )
    )
