import pytest
from pyspark.sql import functions as F
from world import Model, at, make_trip, positions_frame, random_world, trips_frame

from punctual.operators import neighbours, runs


def collect_tracked(frame):
    return {r.seq: (r.id, r.trip_id, r.run, r.highest, r.kind) for r in frame.collect()}


@pytest.mark.parametrize("seed,block_rows", [(1, 1 << 20), (1, 16), (2, 5), (3, 64)])
def test_tracking_equals_the_event_by_event_model(spark, seed, block_rows):
    trips, rows = random_world(seed)
    model = Model(trips, rows)
    hits = runs.detect_hits(positions_frame(spark, rows), trips_frame(spark, trips))
    got = collect_tracked(runs.track_runs(hits, block_rows))
    assert got == {seq: v[:5] for seq, v in model.tracked.items()}


@pytest.mark.parametrize("block_rows", [1 << 20, 9])
def test_snapshots_equal_the_model(spark, block_rows):
    trips, rows = random_world(4)
    model = Model(trips, rows)
    hits = runs.detect_hits(positions_frame(spark, rows), trips_frame(spark, trips))
    got = {r.seq: list(r.real_stop_times) for r in runs.snapshots(runs.track_runs(hits, block_rows), runs.first_arrivals(hits, block_rows)).collect()}
    assert got == {seq: v[5] for seq, v in model.tracked.items()}


def test_trip_switch_gives_three_runs_with_empty_times(spark):
    trips = [make_trip("A", ["08:00:00"] * 3), make_trip("B", ["08:00:00"] * 3)]
    rows = [at(1, "v", "A", 0, 10), at(2, "v", "B", 0, 20), at(3, "v", "A", 1, 30)]
    hits = runs.detect_hits(positions_frame(spark, rows), trips_frame(spark, trips))
    shots = runs.snapshots(runs.track_runs(hits, 2), runs.first_arrivals(hits, 2)).orderBy("seq").collect()
    assert [r.run for r in shots] == [0, 1, 2]
    assert shots[2].real_stop_times == [None, 30, None]


def test_first_visit_wins_and_ties_go_to_the_lower_index(spark):
    trips = [make_trip("A", ["08:00:00"] * 3, places=[0, 0, 2])]
    rows = [at(1, "v", "A", 0, 10), at(2, "v", "A", None, 20), at(3, "v", "A", 0, 50)]
    hits = runs.detect_hits(positions_frame(spark, rows), trips_frame(spark, trips))
    arrivals = runs.first_arrivals(hits).collect()
    assert [(a.hit, a.timestamp) for a in arrivals] == [(0, 10)]


def test_previous_index_crosses_trips_unless_reset(spark):
    trips = [make_trip("A", ["08:00:00"] * 3), make_trip("B", ["08:00:00"] * 3)]
    rows = [at(1, "v", "A", 1, 10), at(2, "v", "B", 1, 20)]
    hits = runs.detect_hits(positions_frame(spark, rows), trips_frame(spark, trips))
    kinds = [r.kind for r in runs.track_runs(hits).orderBy("seq").collect()]
    assert kinds == ["new", "resend"]
    kinds = [r.kind for r in runs.track_runs(hits, reset_on_trip=True).orderBy("seq").collect()]
    assert kinds == ["new", "new"]


def test_high_stop_numbers_stay_in_their_run(spark):
    rows = [("v", 1, 10, "A", 200_000, 150_000), ("v", 2, 20, "A", 200_000, 131_071), ("v", 1 << 21, 30, "B", 3, 1)]
    hits = spark.createDataFrame(rows, "id string, seq long, timestamp long, trip_id string, n_stops int, hit int")
    got = [(r.run, r.highest) for r in runs.track_runs(hits).orderBy("seq").collect()]
    plain = [(r.run, r.highest) for r in runs.track_runs(hits.withColumn("hit", F.expr("hit % 1000"))).orderBy("seq").collect()]
    assert [r for r, _ in got] == [r for r, _ in plain] == [0, 0, 1]
    assert [h for _, h in got] == [150_000, 150_000, 1]


def test_short_trips_are_not_judged(spark):
    trips = [make_trip("A", ["08:00:00"] * 2)]
    hits = runs.detect_hits(positions_frame(spark, [at(1, "v", "A", 1, 10)]), trips_frame(spark, trips))
    assert [r.kind for r in runs.track_runs(hits).collect()] == [None]


def test_enrichment_drops_null_trips_only(spark):
    trips = trips_frame(spark, [make_trip("A", ["08:00:00"] * 3)])
    rows = [at(1, "v", None, 0, 1), at(2, "v", "", 0, 2), at(3, "v", "nope", 0, 3), at(4, "v", "A", 0, 4)]
    got = {r.seq: r.route_type for r in runs.enrich(positions_frame(spark, rows), trips, drop_stops=True).collect()}
    assert got == {2: None, 3: None, 4: 401}


@pytest.mark.parametrize("block_rows", [1, 3, 1 << 20])
def test_previous_event_across_blocks(spark, block_rows):
    _, rows = random_world(6, events=200)
    got = neighbours.with_previous(positions_frame(spark, rows), ["lat", "timestamp"], block_rows=block_rows)
    want, last = {}, {}
    for seq, vehicle, lat, _, _, ts in sorted(rows):
        want[seq] = last.get(vehicle, (None, None))
        last[vehicle] = (lat, ts)
    assert {r.seq: (r.prev_lat, r.prev_timestamp) for r in got.collect()} == want
