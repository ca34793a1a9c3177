import random

import pytest
from pyspark.sql import functions as F
from world import at, make_trip, metres, positions_frame, trips_frame

from punctual.functions.geo import distance_m
from punctual.operators import serving


def test_route_classes(spark):
    given = [100, 401, 700, 900, 1000, 1100, 1501, None, 0]
    rows = spark.createDataFrame([(x,) for x in given], "t int").select(serving.route_class(F.col("t")).alias("c"))
    want = ["train", "metro", "bus", "tram", "water", "other", "taxi", "other", "other"]
    assert [r.c for r in rows.collect()] == want


def test_display_text(spark):
    given = [("13", None, "Ropsten"), (None, None, None), ("", "Red line", ""), ("13", "Red", "X")]
    frame = spark.createDataFrame(given, "a string, b string, c string")
    got = [r.t for r in frame.select(serving.display_text(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()]
    assert got == ["13 mot Ropsten", "Ingen information", "Red line", "13 Red mot X"]


def test_displayable_needs_every_field(spark):
    rows = [("a", 1.0, 1.0, "t", 401), ("b", 0.0, 1.0, "t", 401), ("c", 1.0, 1.0, "", 401), ("d", 1.0, 1.0, "t", None)]
    frame = spark.createDataFrame(rows, "id string, lat double, lng double, trip_id string, route_type bigint")
    assert [r.id for r in frame.filter(serving.is_displayable(frame)).collect()] == ["a"]


def test_latest_positions_keep_the_last_known_route_type(spark):
    rows = [
        (1, "v", 59.0, 18.0, "A", 401),
        (2, "v", 59.1, 18.1, "missing", None),
        (3, "w", 59.0, 18.0, "missing", None),
    ]
    frame = spark.createDataFrame(rows, "seq bigint, id string, lat double, lng double, trip_id string, route_type bigint")
    got = serving.latest_positions(frame).collect()
    assert [(r.id, r.lat, r.trip_id, r.route_type, r.seq, r.entered) for r in got] == [("v", 59.1, "missing", 401, 2, 1)]


def test_predictions_before_the_vehicle_entered_do_not_count(spark):
    state = spark.createDataFrame([("v", 5), ("w", 1)], "id string, entered bigint")
    made = [("v", 3, [1], 4), ("w", 1, [1], 4), ("w", 2, [2], 5), ("x", 2, [2], 5)]
    predictions = spark.createDataFrame(made, "id string, seq bigint, delay array<int>, first_predicted_sequence int")
    got = {r.id: r.delay for r in serving.attach_predictions(state, predictions).collect()}
    assert got == {"v": None, "w": [2]}


def test_merge_adds_only_what_is_absent(spark):
    state = spark.createDataFrame([("v", "A", 700), ("w", "A", None)], "id string, trip_id string, route_type bigint")
    nested = trips_frame(spark, [make_trip("A", ["08:00:00"] * 3)])
    got = {r.id: (r.route_type, r.agency_name) for r in serving.merge_trip_details(state, nested).collect()}
    assert got == {"v": (700, "SL"), "w": (401, "SL")}


BOX = dict(south=58.95, west=17.9, north=59.05, east=18.1)


def test_viewport_keeps_vehicles_that_just_left(spark):
    rows = [at(1, "in", "A", 0, 1), at(2, "left", "A", 0, 1), at(3, "left", "A", 50, 2), at(4, "far", "A", 50, 1)]
    rows += [at(5, "left", "A", 50, 3)]  # standing still keeps the position before
    moves = serving.last_moves(positions_frame(spark, rows))
    assert sorted(r.id for r in serving.viewport_vehicles(moves, **BOX).collect()) == ["in", "left"]


def test_viewport_across_the_antimeridian(spark):
    frame = spark.createDataFrame([("a", 179.5), ("b", -179.5), ("c", 0.0)], "id string, lng double").selectExpr(
        "id", "1.0D as lat", "lng", "1.0D as prev_lat", "lng as prev_lng"
    )
    box = dict(south=0, west=179, north=2, east=-179)
    assert sorted(r.id for r in serving.viewport_vehicles(frame, **box).collect()) == ["a", "b"]
    assert [r.id for r in serving.viewport_vehicles(frame, **box, complement_wrap=True).collect()] == ["c"]


def test_distance_in_metres(spark):
    args = [F.lit(x) for x in (59.0, 18.0, 59.01, 18.02)]
    got = spark.range(1).select(distance_m(*args).alias("d")).first().d
    assert got == pytest.approx(metres(59.0, 18.0, 59.01, 18.02), abs=1e-6)


@pytest.mark.parametrize("centre", [(59.0, 18.0), (-33.0, 179.999), (74.95, -179.999), (85.0, 10.0)])
def test_nearest_vehicle_equals_brute_force(spark, centre):
    rng = random.Random(7)

    def somewhere(i):
        lng = (centre[1] + rng.uniform(-0.03, 0.03) + 180) % 360 - 180
        return (i, round(centre[0] + rng.uniform(-0.01, 0.01), 4), round(lng, 4))

    points = [somewhere(i) for i in range(60)]
    vehicles = [(f"v{i}", *somewhere(i)[1:]) for i in range(60)]
    vehicles += [("a0", *vehicles[3][1:]), ("z9", *vehicles[4][1:])]  # stacked on others
    got = serving.nearest_vehicle(
        spark.createDataFrame(points, "point_id bigint, lat double, lng double"),
        spark.createDataFrame(vehicles, "id string, lat double, lng double"),
        250.0,
    )
    want = {}
    for p, lat, lng in points:
        best = min((round(metres(lat, lng, a, b), 3), v) for v, a, b in vehicles)
        if best[0] < 250:
            want[p] = best[1]
    assert len(want) > 3
    assert {r.point_id: r.id for r in got.collect()} == want


@pytest.mark.parametrize("centre, spread", [((59.0, 18.0), 1e-4), ((59.0, 18.0), 1e-9), ((-33.0, 179.9999), 3e-4), ((0.0, 0.0), 2e-3)])
def test_nearest_vehicle_in_a_crowd(spark, centre, spread):
    """Most vehicles in one cell: the same answers, from a bounded number of pairs."""
    rng = random.Random(11)

    def somewhere(width):
        return centre[0] + rng.uniform(-width, width), (centre[1] + rng.uniform(-width, width) + 180) % 360 - 180

    vehicles = [(f"v{i}", *somewhere(spread)) for i in range(1500)] + [(f"w{i}", *somewhere(0.01)) for i in range(100)]
    vehicles += [("a", *vehicles[0][1:]), ("b", *vehicles[1550][1:])]
    points = [(i, *somewhere(spread if i % 2 else 0.005)) for i in range(60)] + [(100, *vehicles[7][1:]), (101, *vehicles[7][1:])]
    frames = (
        spark.createDataFrame(points, "point_id bigint, lat double, lng double"),
        spark.createDataFrame(vehicles, "id string, lat double, lng double"),
    )
    got = {r.point_id: (r.id, r.dist) for r in serving.nearest_vehicle(*frames, 250.0, cell_rows=8).collect()}
    plain = {r.point_id: (r.id, r.dist) for r in serving.nearest_vehicle(*frames, 250.0, cell_rows=10**9).collect()}
    assert got == plain and len(got) > 30
    cell = serving._met_in_quarters
    seen = []

    def counted(*args):
        seen.append(cell(*args).count())
        return cell(*args)

    serving._met_in_quarters = counted
    try:
        serving.nearest_vehicle(*frames, 250.0, cell_rows=8).count()
    finally:
        serving._met_in_quarters = cell
    if spread > 1e-8:
        assert 0 < seen[0] < 62 * 40 * 8 / 4  # all pairs are more than sixty thousand


def test_long_gaps_are_resampled_in_ranges(spark, monkeypatch):
    rows = [at(1, "v", "A", 0, 1000), at(2, "v", "A", 1, 1000 + 997)]
    whole = serving.resample_tracks(positions_frame(spark, rows), step_s=3).orderBy("timestamp").collect()
    monkeypatch.setattr(serving, "STEPS", 10)
    assert serving.resample_tracks(positions_frame(spark, rows), step_s=3).orderBy("timestamp").collect() == whole
    assert [r.timestamp for r in whole] == list(range(1997, 1997 + 1496, 3))


def test_resampled_tracks(spark):
    rows = [at(1, "v", "A", 0, 1000), at(2, "v", "A", 1, 1040), at(3, "v", "A", 1, 1100), at(4, "v", "A", 0, 1050)]
    got = serving.resample_tracks(positions_frame(spark, rows), step_s=20).orderBy("timestamp").collect()
    assert [(r.seq, r.timestamp) for r in got] == [(2, 1040), (2, 1060), (2, 1080), (2, 1100)]
    assert got[1].lat == pytest.approx(59.0 + 0.01 * 20_000 / 60_001)


def test_timetable_view(spark):
    trip = trips_frame(spark, [make_trip("A", ["08:00:00"] * 3)]).first()
    frame = spark.createDataFrame(
        [("v", "A", trip.stops, [0, 2], 2), ("w", "A", trip.stops, None, None), ("x", "A", trip.stops, [0, 1, 2], 0)],
        "id string, trip_id string, stops array<struct<stop_sequence:int,stop_id:string,stop_name:string,"
        "arrival_time:string,departure_time:string,stop_lat:double,stop_lon:double,shape_dist_traveled:double>>, "
        "delay array<int>, first_predicted_sequence int",
    )
    rows = serving.timetable_view(frame).orderBy("id", "stop_sequence").collect()
    assert [(r.id, r.delay, r.predicted) for r in rows] == [
        ("v", 0, False), ("v", 2, True), ("v", None, True),
        ("w", None, False), ("w", None, False), ("w", None, False),
        ("x", 0, False), ("x", 1, False), ("x", 2, False),
    ]


def test_visit_stats(spark):
    now = 1_000_000
    visits = spark.createDataFrame([(float(now - age),) for age in (0, 3599, 3600, 86_399, 86_400)], "at double")
    assert tuple(serving.visit_stats(visits, F.lit(now)).first()) == (2, 4, 5)
    assert serving.visit_stats(visits).first().total == 5


def test_resend_repeats_the_last_prediction(spark):
    messages = spark.createDataFrame([("v", 1), ("v", 3), ("v", 5), ("w", 9)], "id string, seq bigint")
    made = [("v", 2, [1], 4), ("v", 4, [2], 5)]
    predictions = spark.createDataFrame(made, "id string, seq bigint, delay array<int>, first_predicted_sequence int")
    for block_rows in (1 << 20, 2):
        got = serving.resend_predictions(messages, predictions, block_rows).collect()
        assert sorted((r.id, r.seq, r.delay, r.first_predicted_sequence) for r in got) == [
            ("v", 3, [1], 4), ("v", 5, [2], 5),
        ]


def test_resend_takes_any_form_of_a_delay_and_drops_rows_without_key(spark):
    messages = spark.createDataFrame([("v", 3), ("v", None), (None, 4), ("w", 9)], "id string, seq bigint")
    made = [("v", 2, "1,-", 4), (None, 1, "7", 1), ("v", None, "8", 2), ("w", 1, None, None)]
    predictions = spark.createDataFrame(made, "id string, seq bigint, delay string, first_predicted_sequence int")
    for block_rows in (1 << 20, 2):
        got = serving.resend_predictions(messages, predictions, block_rows).collect()
        assert sorted(map(tuple, got)) == [("v", 3, "1,-", 4), ("w", 9, None, None)]
