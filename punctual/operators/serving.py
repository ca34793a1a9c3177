"""Views for display: latest state, viewport, nearest vehicle, timetable, tracks, site statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, distance_m, in_viewport
from ..session import fresh_folder
from .neighbours import with_previous
from .runs import BLOCK_ROWS, block_of

# Texts shown to the reader.
DIRECTION_WORD = "mot "
NO_INFORMATION = "Ingen information"
NEVER_PREDICTED = 1000

STEPS = 4096  # positions of a resampled gap that one array holds


# ---- rows -----------------------------------------------------------------------------------------------------------


def is_displayable(df: DataFrame) -> Column:
    """Id, position, trip and route type are all there; zero and empty text do not count."""

    def truthy(name: str) -> Column:
        c = F.col(name)
        return (c != "") if dict(df.dtypes)[name] == "string" else ((c != 0) & ~F.isnan(c.cast("double")))

    test = F.lit(True)
    for name in ("id", "lat", "lng", "trip_id", "route_type"):
        test = test & F.coalesce(F.col(name).isNotNull() & truthy(name), F.lit(False))
    return test


def display_text(short: Column, long: Column, headsign: Column) -> Column:
    """Short name, long name and the headsign after a direction word; a default if all are empty."""
    towards = F.concat(F.lit(DIRECTION_WORD), F.nullif(headsign, F.lit("")))
    text = F.concat_ws(" ", F.nullif(short, F.lit("")), F.nullif(long, F.lit("")), towards)
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_INFORMATION))


def route_class(route_type: Column) -> Column:
    """Class of a route type; null, 0 and unlisted types are 'other'."""
    return (
        F.when(route_type.isNull() | (route_type == 0), "other")
        .when(route_type < 400, "train")
        .when(route_type < 700, "metro")
        .when(route_type < 900, "bus")
        .when(route_type < 1000, "tram")
        .when(route_type.isin(1000, 1200), "water")
        .when(route_type.between(1500, 1507), "taxi")
        .otherwise("other")
    )


def live_message() -> Column:
    """Live position message as JSON text; an unknown route type is left out."""
    return F.to_json(F.struct("id", "lat", "lng", "trip_id", "route_type"))


def live_json(enriched: DataFrame) -> DataFrame:
    return enriched.select(live_message().alias("value"))


# ---- latest state ---------------------------------------------------------------------------------------------------


def latest_state(events: DataFrame, fields: list[str], key: str = "id", order: str = "seq") -> DataFrame:
    """Per key the last non-null value of every field; a pre-combined aggregate, so hot keys are cheap."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return events.groupBy(key).agg(*last, F.max(order).alias(order))


def latest_row(events: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Per key the row with the highest order value."""
    rest = [c for c in events.columns if c not in (key, order)]
    return (
        events.groupBy(key)
        .agg(F.max(F.struct(order, *rest)).alias("_row"))
        .select(key, f"_row.{order}", *[f"_row.{c}" for c in rest])
    )


def latest_positions(enriched: DataFrame) -> DataFrame:
    """Latest state of every vehicle that has appeared with a displayable event, and when it ``entered``.

    Position and trip are present in every event and the entering event has a route type, so the last non-null
    values over all events are those since the entry; one aggregate answers both.
    """
    fields = ["lat", "lng", "trip_id", "route_type"]
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    entered = F.min(F.when(is_displayable(enriched), F.col("seq"))).alias("entered")
    return enriched.groupBy("id").agg(*last, F.max("seq").alias("seq"), entered).filter("entered is not null")


def merge_trip_details(state: DataFrame, trips_nested: DataFrame) -> DataFrame:
    """Add trip details to vehicles; values the vehicle already has stay."""
    details = [c for c in trips_nested.columns if c != "trip_id"]
    meta = trips_nested.select("trip_id", *[F.col(c).alias(f"_m_{c}") for c in details])
    merged = [
        F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in state.columns else F.col(f"_m_{c}").alias(c)
        for c in details
    ]
    own = [c for c in state.columns if c not in details]
    return state.join(meta, "trip_id", "left").select(*own, *merged)


def attach_predictions(state: DataFrame, predictions: DataFrame) -> DataFrame:
    """Latest prediction of every vehicle; those made before the vehicle ``entered`` the view are ignored."""
    made = predictions.select("id", F.col("seq").alias("made"), "delay", "first_predicted_sequence")
    latest = latest_row(made, order="made")
    valid = F.col("made") >= F.col("entered")
    return state.join(latest, "id", "left").select(
        *state.columns,
        F.when(valid, F.col("delay")).alias("delay"),
        F.when(valid, F.col("first_predicted_sequence")).alias("first_predicted_sequence"),
    )


def resend_predictions(
    messages: DataFrame, predictions: DataFrame, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The prediction to repeat for every bare-id message: the last one before it; none before the first.

    A running 'last value' over one vehicle, cut into blocks like the other ordered steps. The rows are dealt by
    (vehicle, block) before anything else: the blocks' last answers and the rows themselves come from one exchange, so
    the predictions are decoded once. ``delay`` may be of any type, as it is only handed on.
    """
    made = predictions.select(
        "id", "seq", F.struct("delay", F.col("first_predicted_sequence").alias("first")).alias("answer")
    )
    asked = messages.select("id", "seq", F.lit(None).cast(made.schema["answer"].dataType).alias("answer"))
    both = (
        asked.unionByName(made)
        .withColumn("block", block_of(F.col("seq"), block_rows))
        .filter(F.col("id").isNotNull() & F.col("block").isNotNull())  # as the join does, but before the exchange
        .repartition("id", "block")
    )
    w = W.partitionBy("id", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    carry = (
        both.groupBy("id", "block")
        .agg(F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("seq"))).alias("edge"))
        .withColumn(
            "carry",
            F.last("edge", ignorenulls=True).over(
                W.partitionBy("id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .select("id", "block", "carry")
    )
    return (
        both.withColumn("asked", F.col("answer").isNull())
        .withColumn("local", F.last("answer", ignorenulls=True).over(w))
        .filter("asked")
        .join(carry, ["id", "block"])
        .withColumn("answer", F.coalesce("local", "carry"))
        .filter(F.col("answer").isNotNull())
        .select("id", "seq", "answer.delay", F.col("answer.first").alias("first_predicted_sequence"))
    )


# ---- map ------------------------------------------------------------------------------------------------------------


def last_moves(events: DataFrame) -> DataFrame:
    """Per vehicle the current position and the different one before it (itself if it never moved).

    Both follow from the last sighting of every distinct position, which is aggregated before the shuffle; the
    top two are kept per map task first, so a vehicle with many positions does not gather in one task.
    """
    spots = events.groupBy("id", "lat", "lng").agg(F.max("seq").alias("seq"))
    top = (
        spots.withColumn("_rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("seq"))))
        .filter(F.col("_rank") <= 2)
        .groupBy("id")
        .agg(
            F.max(F.struct("seq", "lat", "lng")).alias("_now"),
            F.min(F.struct("seq", "lat", "lng")).alias("_then"),
        )
    )
    return top.select(
        "id",
        F.col("_now.seq").alias("seq"),
        F.col("_now.lat").alias("lat"),
        F.col("_now.lng").alias("lng"),
        F.col("_then.lat").alias("prev_lat"),
        F.col("_then.lng").alias("prev_lng"),
    )


def viewport_vehicles(
    moves: DataFrame, south: float, west: float, north: float, east: float, complement_wrap: bool = False
) -> DataFrame:
    """Vehicles whose current or previous position is in the box."""
    box = (south, west, north, east)
    return moves.filter(
        in_viewport(F.col("lat"), F.col("lng"), F.col("prev_lat"), F.col("prev_lng"), *box, complement_wrap)
    )


#: Vehicles in one cell beyond which it is divided, into how many rows and columns, and how often at most.
CELL_ROWS, CELL_SPLIT, CELL_LEVELS = 256, 8, 8


def nearest_vehicle(
    points: DataFrame, vehicles: DataFrame, cutoff_m: float, max_abs_lat: float = 75.0, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """For every point ``(point_id, lat, lng)`` the closest vehicle nearer than the cut-off, if any.

    An equi-join on grid cells at least as wide as the cut-off. Stacked vehicles and repeated points are folded
    first, so the join meets distinct coordinates only. Distances count in millimetres and the lowest id wins
    ties. Beyond ``max_abs_lat`` the cells are one row of latitude bands, since degrees of longitude shrink there.

    A cell of more than ``cell_rows`` vehicles is divided into smaller ones, and these again. A point goes down the
    cells with bounds: every cell that holds a vehicle says how far the nearest one is at most and at least, and
    cells that are farther at least than another is at most are left. So a point meets a few cells of a bounded
    number of vehicles, however dense they stand.
    """
    metres_per_degree = math.pi / 180 * EARTH_RADIUS_KM * 1000
    lat_step = cutoff_m / metres_per_degree * 1.01
    lng_step = min(lat_step / math.cos(math.radians(max_abs_lat)), 360.0)
    columns = math.floor(360.0 / lng_step)
    lng_step = 360.0 / columns

    def row(lat: Column) -> Column:
        return F.floor(lat / lat_step)

    def col(lat: Column, lng: Column) -> Column:
        inside = F.floor((lng + 180.0) / lng_step)
        return F.when(F.abs(lat) < max_abs_lat - 2 * lat_step, F.pmod(inside, F.lit(columns))).otherwise(F.lit(-1))

    spots = (
        vehicles.groupBy("lat", "lng")
        .agg(F.min("id").alias("id"))
        .select("id", F.col("lat").alias("v_lat"), F.col("lng").alias("v_lng"))
        .withColumn("cell_row", row(F.col("v_lat")))
        .withColumn("cell_col", col(F.col("v_lat"), F.col("v_lng")))
    )
    places = points.select("lat", "lng").distinct()
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    probes = (
        places.withColumn("cell_row", F.explode(F.transform(near, lambda d: row(F.col("lat")) + d)))
        .withColumn(
            "cell_col",
            F.explode(
                F.array_distinct(
                    F.concat(
                        F.transform(
                            near,
                            lambda d: F.pmod(F.floor((F.col("lng") + 180.0) / lng_step) + d, F.lit(columns)),
                        ),
                        F.array(F.lit(-1).cast("bigint")),
                    )
                )
            ),
        )
    )
    cell = ["cell_row", "cell_col"]
    dense = spots.filter("cell_col >= 0").groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    crowd = dense.agg(F.max("n")).first()[0]
    if crowd is None:
        met = probes.join(spots, cell)
    else:
        dense = dense.select(*cell)
        met = probes.join(spots.join(dense, cell, "left_anti"), cell).select("lat", "lng", "id", "v_lat", "v_lng")
        inside = spots.join(dense, cell, "left_semi")
        met = met.unionByName(_met_in_quarters(probes.join(dense, cell, "left_semi"), inside, lat_step, lng_step, cell_rows))
    hits = (
        met.withColumn("exact", distance_m(F.col("lat"), F.col("lng"), F.col("v_lat"), F.col("v_lng")))
        .filter(F.col("exact") < cutoff_m)
        .withColumn("dist", F.round("exact", 3))
        .groupBy("lat", "lng")
        .agg(F.min(F.struct("dist", "id")).alias("best"))
    )
    return points.join(hits, ["lat", "lng"]).select("point_id", "best.id", "best.dist")


def _met_in_quarters(probes: DataFrame, spots: DataFrame, lat_step: float, lng_step: float, cell_rows: int) -> DataFrame:
    """Pairs of a point and the vehicles of the cells that may hold its nearest one.

    The cells of one level are (row, column) of a grid whose steps are an eighth of the level before. Levels go on while a
    cell holds more than ``cell_rows`` vehicles; each is one join of the points still on their way with the cells that
    hold vehicles, of which a parent has at most 64. What a level leaves to the next is a written table.
    """
    done, out = probes.select("lat", "lng", *_of_level(0)), None
    for level in range(1, CELL_LEVELS + 1):
        steps = lat_step / CELL_SPLIT**level, lng_step / CELL_SPLIT**level
        names, parents = _of_level(level), _of_level(level - 1)
        spots = _written(
            spots.withColumns({names[0]: F.floor(F.col("v_lat") / steps[0]), names[1]: F.floor((F.col("v_lng") + 180.0) / steps[1])})
        )
        # The box of the vehicles themselves bounds them closer than the cell does.
        sides = [f("v_" + c).alias(f"{c}_{n}") for c in ("lat", "lng") for f, n in ((F.min, "low"), (F.max, "high"))]
        quarters = spots.groupBy(*parents, *names).agg(F.count(F.lit(1)).alias("n"), *sides)
        quarters = _written(quarters.withColumn("last", (F.col("n") <= cell_rows) | F.lit(level == CELL_LEVELS)))
        w = W.partitionBy("lat", "lng")
        reached = _written(
            done.join(quarters, parents)
            .withColumn("least", _box_distance(F.least) * 0.99 - 0.01)
            .withColumn("most", _box_distance(F.greatest) * 1.01 + 0.01)
            .withColumn("bound", F.min("most").over(w))
            .filter(F.col("least") <= F.col("bound"))
            .select("lat", "lng", *names, "last")
        )
        ends = reached.filter("last").join(spots, names).select("lat", "lng", "id", "v_lat", "v_lng")
        out = ends if out is None else out.unionByName(ends)
        if quarters.filter("not last").isEmpty():
            return out
        spots = spots.join(quarters.filter("not last").select(*names), names, "left_semi").select("id", "v_lat", "v_lng", *names)
        done = reached.filter("not last").drop("last")
    return out


def _written(df: DataFrame) -> DataFrame:
    path = fresh_folder(df.sparkSession, "cells")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _of_level(level: int) -> list[str]:
    return ["cell_row", "cell_col"] if level == 0 else [f"row{level}", f"col{level}"]


def _box_distance(pick) -> Column:
    """Distance of a point to the nearest (``F.least``) or farthest (``F.greatest``) place of a box of vehicles."""

    def side(at: Column, low: Column, high: Column) -> Column:
        if pick is F.least:
            return F.least(F.greatest(at, low), high)
        return F.when(F.abs(at - low) > F.abs(at - high), low).otherwise(high)

    lat, lng = F.col("lat"), F.col("lng")
    turned = lng - F.round((lng - F.col("lng_low")) / 360.0) * 360.0  # on the same side of the antimeridian as the box
    near_lat = side(lat, F.col("lat_low"), F.col("lat_high"))
    return distance_m(lat, lng, near_lat, side(turned, F.col("lng_low"), F.col("lng_high")))


def resample_tracks(positions: DataFrame, step_s: int, stretch: float = 1.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Positions every ``step_s`` seconds between two fixes of a vehicle.

    The move from the previous fix to the new one starts when the new one arrives and takes ``stretch`` times
    the gap between them; the fraction is elapsed / (duration + 1) in milliseconds. A long gap is cut into ranges of
    ``STEPS`` positions first, so no array grows with it.
    """
    pairs = with_previous(positions.select("id", "seq", "lat", "lng", "timestamp"), ["lat", "lng", "timestamp"],
                          block_rows=block_rows)
    gap_ms = (F.col("timestamp") - F.col("prev_timestamp")) * 1000
    moved = (F.col("lat") != F.col("prev_lat")) | (F.col("lng") != F.col("prev_lng"))
    duration = gap_ms * F.lit(float(stretch))
    last = F.floor(duration / 1000).cast("bigint")
    fraction = F.col("elapsed") * 1000 / (F.col("duration") + 1)
    return (
        pairs.filter((gap_ms > 0) & moved)
        .withColumn("duration", duration)
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(step_s * STEPS).cast("bigint"))))
        .withColumn("_to", F.least(last, F.col("_from") + step_s * (STEPS - 1)))
        .withColumn("elapsed", F.explode(F.sequence(F.col("_from"), F.col("_to"), F.lit(step_s).cast("bigint"))))
        .select(
            "id",
            "seq",
            (F.col("timestamp") + F.col("elapsed")).alias("timestamp"),
            (F.col("prev_lat") * (1 - fraction) + F.col("lat") * fraction).alias("lat"),
            (F.col("prev_lng") * (1 - fraction) + F.col("lng") * fraction).alias("lng"),
        )
    )


# ---- timetable and statistics ---------------------------------------------------------------------------------------


def timetable_view(vehicles: DataFrame) -> DataFrame:
    """One row per stop of each vehicle's trip with the predicted delay and whether it lies ahead.

    ``vehicles`` has ``id, trip_id, stops, delay, first_predicted_sequence``; delays are looked up by
    stop_sequence - 1.
    """
    first = F.coalesce(F.nullif(F.col("first_predicted_sequence"), F.lit(0)), F.lit(NEVER_PREDICTED))
    return vehicles.select("id", "trip_id", "delay", first.alias("_first"), F.explode("stops").alias("stop")).select(
        "id",
        "trip_id",
        "stop.stop_sequence",
        "stop.stop_name",
        "stop.arrival_time",
        F.get("delay", F.col("stop.stop_sequence") - 1).alias("delay"),
        (F.col("stop.stop_sequence") >= F.col("_first")).alias("predicted"),
    )


def visit_stats(visits: DataFrame, now: Column | None = None) -> DataFrame:
    """Visits of the last hour, the last 24 hours, and all; ``visits`` has epoch seconds ``at``."""
    if now is None:
        now = F.unix_micros(F.current_timestamp()) / 1e6
    age = now - F.col("at")
    return visits.agg(
        F.count_if(age < 3_600).alias("last_hour"),
        F.count_if(age < 86_400).alias("last_day"),
        F.count(F.lit(1)).alias("total"),
    )
