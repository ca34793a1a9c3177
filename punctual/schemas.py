"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T



def _columns(**types: str) -> T.StructType:
    schema = T.StructType()
    for name, kind in types.items():
        schema = schema.add(name, kind)
    return schema


AGENCY = _columns(
    agency_id="long",
    agency_name="string",
    agency_url="string",
    agency_timezone="string",
    agency_lang="string",
    agency_fare_url="string",
)
ROUTES = _columns(
    route_id="string",
    agency_id="long",
    route_short_name="string",
    route_long_name="string",
    route_type="long",
    route_desc="string",
)
TRIPS = _columns(
    route_id="string",
    service_id="long",
    trip_id="string",
    trip_headsign="string",
    direction_id="integer",
    shape_id="long",
)
STOP_TIMES = _columns(
    trip_id="string",
    arrival_time="string",
    departure_time="string",
    stop_id="string",
    stop_sequence="integer",
    stop_headsign="string",
    shape_dist_traveled="double",
)
STOPS = _columns(
    stop_id="string",
    stop_name="string",
    stop_lat="double",
    stop_lon="double",
)

STOP_DDL = (
    "struct<stop_sequence:int,stop_id:string,stop_name:string,arrival_time:string,departure_time:string,"
    "stop_lat:double,stop_lon:double,shape_dist_traveled:double>"
)
TRIP_ATTRIBUTES = [
    "shape_id",
    "route_id",
    "direction_id",
    "route_type",
    "route_short_name",
    "route_long_name",
    "trip_headsign",
    "agency_id",
    "agency_name",
]
STOP_FIELDS = [
    "stop_sequence",
    "stop_id",
    "stop_name",
    "arrival_time",
    "departure_time",
    "stop_lat",
    "stop_lon",
    "shape_dist_traveled",
]

# One row per trip with the stop lists as pipe-joined text (interchange form of the trip table).
TRIP_LISTS = _columns(
    trip_id="string",
    shape_id="long",
    route_id="string",
    direction_id="integer",
    route_type="long",
    route_short_name="string",
    route_long_name="string",
    trip_headsign="string",
    agency_id="long",
    agency_name="string",
    stop_id="string",
    stop_name="string",
    stop_lat="string",
    stop_lon="string",
    stop_sequence="string",
    arrival_time="string",
    departure_time="string",
    shape_dist_traveled="string",
)

# Vehicle position feed: one message holds many entities.
FEED = T.StructType().add(
    "entity",
    T.ArrayType(
        T.StructType().add(
            "vehicle",
            T.StructType()
            .add("trip", _columns(trip_id="string"))
            .add("vehicle", _columns(id="string"))
            .add("position", _columns(latitude="double", longitude="double"))
            .add("timestamp", "long"),
        )
    ),
)
POSITIONS = _columns(
    seq="long",
    id="string",
    lat="double",
    lng="double",
    trip_id="string",
    timestamp="long",
)

ARCHIVE = _columns(
    id="string",
    lng="double",
    lat="double",
    timestamp="long",
    trip_id="string",
    route_type="long",
    agency_name="string",
    route_short_name="string",
    route_long_name="string",
    trip_headsign="string",
    shape_id="long",
    direction_id="integer",
)

SEQUENCE_LENGTH = 75


def feature_column(i: int) -> str:
    return f"feature_{i:02d}"
