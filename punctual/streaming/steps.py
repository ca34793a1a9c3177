"""Composition of steps and the keyed, stateful form of stop detection and change detection.

One key's events must be seen in order, so the stream keeps state per vehicle: the current trip, its real stop
times, and the highest index of the vehicle's last prediction. The batch operators give the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import MIN_STOPS

StepFn = Callable[[DataFrame], DataFrame]

STATE_TTL_MS = 6 * 3600 * 1000

STATE_SCHEMA = "trip_id string, run bigint, times array<bigint>, judged int"
TRACKED_SCHEMA = (
    "id string, seq bigint, timestamp bigint, trip_id string, n_stops int, hit int, run bigint, highest int, "
    "kind string, newly_reached boolean, real_stop_times array<bigint>"
)


def chain(df: DataFrame, *steps: StepFn) -> DataFrame:
    """Apply steps in order; each may change, drop or add rows and columns."""
    for step in steps:
        df = df.transform(step)
    return df


def vehicle_tracker(ttl_ms: int | None = None) -> StatefulProcessor:
    """The keyed processor. Its class is local to this function, so Spark ships it by value and the Python workers
    need not have this package installed."""

    class VehicleTracker(StatefulProcessor):
        """Per vehicle: trip runs, first arrivals, snapshots and 'new' / 'resend' marks, in ``seq`` order."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("vehicle", STATE_SCHEMA, ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            if self.state.exists():
                trip, run, times, judged = self.state.get()
                times = list(times)
            else:
                trip, run, times, judged = None, -1, [], None
            events = pd.concat(list(rows)).sort_values(["seq", "timestamp"], kind="stable")
            out = []
            for e in events.itertuples(index=False):
                if e.trip_id != trip:
                    trip, run, times = e.trip_id, run + 1, [None] * int(e.n_stops)
                hit = None if pd.isna(e.hit) else int(e.hit)
                newly = hit is not None and times[hit] is None
                if newly:
                    times[hit] = int(e.timestamp)
                reached = [i for i, t in enumerate(times) if t is not None]
                highest = reached[-1] if reached else 0
                kind = None
                if e.n_stops >= MIN_STOPS:
                    kind = "resend" if judged == highest else "new"
                    judged = highest
                out.append(
                    (key[0], e.seq, e.timestamp, trip, e.n_stops, hit, run, highest, kind, newly, list(times))
                )
            self.state.update((trip, run, times, judged))
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in TRACKED_SCHEMA.split(", ")])
            frame["hit"] = frame["hit"].astype("Int32")
            yield frame

        def close(self) -> None:
            pass

    return VehicleTracker()


def track_stream(hits: DataFrame, ttl_ms: int | None = STATE_TTL_MS) -> DataFrame:
    """Streaming counterpart of ``track_runs`` + ``snapshots`` over the narrow events of ``detect_hits``.

    One shuffle by vehicle into the state store. ``ttl_ms`` evicts the state of silent vehicles; a vehicle
    that returns later starts a new run. None keeps all state. The rows of one vehicle in one micro-batch are
    sorted in the worker, so the source's rate limit (``maxFilesPerTrigger``) bounds their number.
    """
    time_mode = "none" if ttl_ms is None else "processingTime"
    return hits.groupBy("id").transformWithStateInPandas(
        statefulProcessor=vehicle_tracker(ttl_ms),
        outputStructType=TRACKED_SCHEMA,
        outputMode="Append",
        timeMode=time_mode,
    )


def stream_arrivals(tracked: DataFrame) -> DataFrame:
    """First arrivals as they happen."""
    return tracked.filter("newly_reached").select("id", "run", "trip_id", "n_stops", "hit", "seq", "timestamp")


def gate_open(tracked: DataFrame) -> DataFrame:
    """The one event per run at which the trip has reached its last stop with at most half of the stops missing.

    Same columns as the batch gate. Only an arrival can open the gate, and the state before it lacks just the
    stop that was reached.
    """
    n = F.col("n_stops")
    allowed = F.floor(n / 2)
    missing = F.size(F.filter("real_stop_times", lambda t: t.isNull()))
    is_open = F.get("real_stop_times", n - 1).isNotNull() & (missing <= allowed)
    was_open = (F.col("hit") != n - 1) & (missing + 1 <= allowed)
    return tracked.filter((n >= MIN_STOPS) & F.col("newly_reached") & is_open & ~was_open).select(
        "id", "run", "trip_id", "n_stops", "seq", "timestamp", F.col("real_stop_times").alias("times")
    )


def once_per_trip_and_day(gated: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """At most one row per trip and service day while the watermark keeps the trip in state."""
    at = F.timestamp_seconds("timestamp")
    return (
        gated.withColumn("event_time", at)
        .withColumn("service_date", F.to_date(at))
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["trip_id", "service_date"])
        .drop("event_time", "service_date")
    )
