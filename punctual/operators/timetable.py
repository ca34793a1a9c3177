"""Static timetable: five tables to one row per trip with its ordered stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import STOP_DDL, STOP_FIELDS, TRIP_ATTRIBUTES


def prune_timetable(
    trips: DataFrame, routes: DataFrame, agency: DataFrame, stop_times: DataFrame, stops: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Keep the columns in use and name the headsign after the trip."""
    return (
        trips.select("route_id", "trip_id", "shape_id", "direction_id"),
        routes.select("route_id", "agency_id", "route_type", "route_short_name", "route_long_name"),
        agency.select("agency_id", "agency_name"),
        stop_times.withColumnRenamed("stop_headsign", "trip_headsign"),
        stops.select("stop_id", "stop_name", "stop_lat", "stop_lon"),
    )


def nest_trips(
    trips: DataFrame, routes: DataFrame, agency: DataFrame, stop_times: DataFrame, stops: DataFrame
) -> DataFrame:
    """``trips_nested``: one row per trip, stops ordered by stop_sequence, null stops where a trip has no times.

    Stop times are the large table. They meet the small stop table first (broadcast when Spark sees that it is
    small enough), are folded per trip with map-side combine, and only the folded rows meet the trips, so the
    large side is shuffled once. A trip's list is bounded by the timetable key (trip_id, stop_sequence).
    """
    trips, routes, agency, stop_times, stops = prune_timetable(trips, routes, agency, stop_times, stops)
    entry = F.struct(*[F.col(c) for c in STOP_FIELDS])
    folded = (
        stop_times.join(stops, "stop_id", "left")
        .groupBy("trip_id")
        .agg(
            F.expr("min_by(trip_headsign, stop_sequence) filter (where trip_headsign is not null)").alias(
                "trip_headsign"
            ),
            F.array_sort(F.collect_list(entry)).alias("stops"),
        )
    )
    lines = routes.join(agency, "agency_id", "left")
    return (
        trips.join(lines, "route_id", "left")
        .join(folded, "trip_id", "left")
        .select("trip_id", *TRIP_ATTRIBUTES, F.col("stops").cast(f"array<{STOP_DDL}>").alias("stops"))
    )


def one_row_per_trip(trips_nested: DataFrame, version: str | None = None) -> DataFrame:
    """Keep one row per trip_id, the one with the highest ``version`` (any row if there is no version).

    Without a version the rows are numbered inside a trip: an aggregate would copy every list of stops twice.
    """
    if version is None:
        numbered = trips_nested.withColumn("_nth", F.row_number().over(W.partitionBy("trip_id").orderBy("trip_id")))
        return numbered.filter("_nth = 1").drop("_nth")
    rest = [c for c in trips_nested.columns if c != "trip_id"]
    return (
        trips_nested.groupBy("trip_id")
        .agg(F.max_by(F.struct(*rest), F.col(version)).alias("row"))
        .select("trip_id", *[F.col(f"row.{c}").alias(c) for c in rest])
    )


def _pipe(stops: Column, field: str) -> Column:
    return F.array_join(F.transform(stops, lambda s: F.coalesce(s[field].cast("string"), F.lit("nan"))), "|")


def to_pipe_lists(trips_nested: DataFrame) -> DataFrame:
    """Interchange form: eight pipe-joined lists beside the trip attributes; null lists where stops are null."""
    order = [
        "stop_id",
        "stop_name",
        "stop_lat",
        "stop_lon",
        "stop_sequence",
        "arrival_time",
        "departure_time",
        "shape_dist_traveled",
    ]
    return trips_nested.select(
        "trip_id", *TRIP_ATTRIBUTES, *[_pipe(F.col("stops"), field).alias(field) for field in order]
    )


def _all_parse(values: Column, kind: str) -> Column:
    return F.forall(values, lambda x: x.try_cast(kind).isNotNull())


NUMERIC = {
    "stop_sequence": "int",
    "stop_lat": "double",
    "stop_lon": "double",
    "shape_dist_traveled": "double",
}


def _split_lists(lists: DataFrame) -> DataFrame:
    """The lists as arrays (``_<field>``), and whether they are of one length and parse (``_aligned``)."""
    parts = {field: F.split(F.col(field), r"\|") for field in STOP_FIELDS}
    split = lists.select("*", *[parts[f].alias(f"_{f}") for f in STOP_FIELDS])
    aligned = F.lit(True)
    for field in STOP_FIELDS:
        same = F.size(f"_{field}") == F.size("_stop_id")
        both_empty = F.col(field).isNull() & F.col("stop_id").isNull()
        aligned = aligned & F.coalesce(same & F.col(field).isNotNull(), F.lit(False)) | (aligned & both_empty)
        if field in NUMERIC:
            aligned = aligned & F.coalesce(_all_parse(F.col(f"_{field}"), NUMERIC[field]), F.lit(True))
    return split.withColumn("_aligned", aligned)


def judge_pipe_lists(lists: DataFrame) -> DataFrame:
    """Every row of ``lists`` with ``parsed``, whether ``from_pipe_lists`` takes it, and ``n_calls``, the length of its list of
    stops (null if there is none). Both kinds come from one scan, and every list is split once."""
    split = _split_lists(lists)
    return split.select(*lists.columns, F.col("_aligned").alias("parsed"), F.size("_stop_id").alias("n_calls"))


def from_pipe_lists(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Back to ``trips_nested``; the second frame holds the rows whose lists differ in length or do not parse."""
    split = _split_lists(lists)

    def stop_at(i: Column) -> Column:
        return F.struct(
            *[
                F.get(F.col(f"_{f}"), i).try_cast(NUMERIC.get(f, "string")).alias(f)
                for f in STOP_FIELDS
            ]
        )

    positions = F.sequence(F.lit(0), F.size("_stop_id") - 1)
    stops = F.when(F.col("stop_id").isNotNull(), F.transform(positions, stop_at))
    good = split.filter("_aligned").select("trip_id", *TRIP_ATTRIBUTES, stops.alias("stops"))
    bad = split.filter(~F.col("_aligned")).select(*lists.columns)
    return good, bad


def compact_stops(trips_nested: DataFrame) -> DataFrame:
    """Reduced stop records for display."""
    fields = ["stop_sequence", "stop_name", "stop_lon", "stop_lat", "arrival_time"]
    return trips_nested.withColumn(
        "stops", F.transform("stops", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    )


def lookup_trip(trips_nested: DataFrame, trip_id: str) -> DataFrame:
    """The trip with this id; an empty frame means not found. The predicate reaches the file scan."""
    return trips_nested.filter(F.col("trip_id") == F.lit(trip_id))
