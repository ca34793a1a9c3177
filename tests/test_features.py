import pytest
from pyspark.sql import functions as F
from world import Model, at, clock, make_trip, positions_frame, random_world, trips_frame

from punctual.functions import schedule as sch
from punctual.functions.vocabulary import METRO_ROUTES, METRO_STOPS, Layout, delta_token, route_tokens, stop_tokens
from punctual.functions.vocabulary import token_table
from punctual.operators import features, punctuality, runs

LAYOUT = Layout(routes=3, stops=8)
NOON = 1_700_000_000 // 86_400 * 86_400 + 43_200


def words(spark):
    return (
        route_tokens(spark, [f"R{i}" for i in range(LAYOUT.routes)]),
        stop_tokens(spark, [f"S{i}" for i in range(LAYOUT.stops)]),
    )


def prepare(spark, trips, rows, block_rows=1 << 20):
    """Tracked events, first arrivals, and the static part of the sequences."""
    nested = trips_frame(spark, trips)
    hits = runs.detect_hits(positions_frame(spark, rows), nested)
    codes = features.encode_trips(nested, *words(spark), LAYOUT)
    return runs.track_runs(hits, block_rows), runs.first_arrivals(hits, block_rows), codes


@pytest.mark.parametrize("seed,block_rows", [(11, 1 << 20), (12, 20)])
def test_training_sequences_equal_the_model(spark, seed, block_rows):
    trips, rows = random_world(seed, events=1500)
    model = Model(trips, rows)
    got = features.training_sequences(*prepare(spark, trips, rows, block_rows)[1:], LAYOUT).collect()
    want = {}
    for trip, (seq, vehicle, times, ts) in model.gated.items():
        tokens = model.tokens(trip, times, ts, LAYOUT)
        if tokens is not None:
            want[trip] = (seq, vehicle, tokens)
    assert len(want) > 2
    assert {r.trip_id: (r.seq, r.id, list(r.tokens)) for r in got} == want


@pytest.mark.parametrize("seed,block_rows", [(13, 1 << 20), (14, 20)])
def test_inference_messages_equal_the_model(spark, seed, block_rows):
    trips, rows = random_world(seed, events=800)
    model = Model(trips, rows)
    tracked, arrivals, codes = prepare(spark, trips, rows, block_rows)
    sequences = features.inference_sequences(tracked, arrivals, codes, LAYOUT)
    got = {r.seq: r.message for r in features.inference_messages(tracked, sequences).collect()}
    stamp = {r[0]: r[5] for r in rows}
    want = {}
    for seq, (vehicle, trip, _, highest, kind, times) in model.tracked.items():
        if kind == "resend":
            want[seq] = vehicle
        elif kind == "new":
            tokens = model.tokens(trip, times, stamp[seq], LAYOUT, upto=highest)
            if tokens is not None:
                want[seq] = f"{vehicle}:{','.join(map(str, tokens))}"
    assert got == want


def test_delta_buckets(spark):
    given = [-901, -900, -90, -59, 0, 59, 60, 61, 900, 5000]
    rows = spark.createDataFrame([(x,) for x in given], "x bigint").select(delta_token(F.col("x")).alias("t"))
    assert [r.t for r in rows.collect()] == [0, 0, 14, 15, 15, 15, 16, 16, 30, 30]


def test_schedule_rolls_over_midnight_and_reads_zones(spark):
    frame = spark.createDataFrame([(["23:50:00", "23:58:00", "00:05:00"], 1_700_000_000)], "t array<string>, ts bigint")
    seconds, day = sch.day_seconds(F.col("t")), sch.event_day(F.col("ts"))
    row = frame.select(
        sch.resolve(seconds, day, sch.rollover_index(seconds)).alias("fixed"),
        sch.resolve_in_zone(seconds, day, sch.rollover_index(seconds), "Europe/Stockholm").alias("zoned"),
    ).first()
    midnight = 1_700_000_000 // 86_400 * 86_400
    want = [midnight - 600 - 3600, midnight - 120 - 3600, midnight + 300 - 3600]
    assert row.fixed == want
    assert row.zoned == want  # November: winter time


def test_malformed_times_are_null(spark):
    frame = spark.createDataFrame([(["24:10:00", "6:05:09", "x", "10:00", "aa:bb:cc"],)], "t array<string>")
    assert frame.select(sch.day_seconds(F.col("t")).alias("s")).first().s == [87_000, 21_909, None, None, None]


def sequence_of(spark, stops_hit, n=5, times=None):
    times = times or [clock(43_200 + 3600 + 120 * i) for i in range(n)]
    rows = [at(9, "v", "A", None, NOON)]
    rows = [at(i, "v", "A", p, NOON + 120 * p) for i, p in enumerate(stops_hit)] or rows
    return prepare(spark, [make_trip("A", times)], rows)


def test_no_stop_reached_asks_once_for_everything_ahead(spark):
    tracked, arrivals, codes = sequence_of(spark, [])
    rows = features.inference_sequences(tracked, arrivals, codes, LAYOUT).collect()
    assert len(rows) == 1 and rows[0].highest == 0
    assert list(rows[0].tokens).index(LAYOUT.skip) == 9


def test_third_stop_reached_leaves_one_skip(spark):
    tracked, arrivals, codes = sequence_of(spark, [0, 1, 2])
    last = max(features.inference_sequences(tracked, arrivals, codes, LAYOUT).collect(), key=lambda r: r.seq)
    assert last.tokens.count(LAYOUT.skip) == 1 and list(last.tokens).index(LAYOUT.skip) == 13


def test_trips_past_hour_24_give_resend_marks_only(spark):
    times = ["23:50:00", "24:10:00", "24:20:00"]
    tracked, arrivals, codes = prepare(
        spark, [make_trip("A", times)], [at(1, "v", "A", 0, NOON), at(2, "v", "A", 0, NOON + 9)]
    )
    sequences = features.inference_sequences(tracked, arrivals, codes, LAYOUT)
    assert [r.message for r in features.inference_messages(tracked, sequences).collect()] == ["v"]


@pytest.mark.parametrize("hit,opens", [([0, 2, 4], True), ([0, 4], False), ([0, 1, 2, 3], False), ([4, 0, 1], True)])
def test_training_gate(spark, hit, opens):
    tracked, arrivals, codes = sequence_of(spark, hit)
    assert len(features.training_sequences(arrivals, codes, LAYOUT).collect()) == int(opens)


def test_same_trip_on_two_vehicles_gives_one_row(spark):
    times = [clock(50_000 + 60 * i) for i in range(3)]
    rows = [at(10 * v + p, f"v{v}", "A", p, NOON + p) for v in (1, 2) for p in range(3)]
    tracked, arrivals, codes = prepare(spark, [make_trip("A", times)], rows)
    assert [r.id for r in features.training_sequences(arrivals, codes, LAYOUT).collect()] == ["v1"]


def test_aligned_deltas(spark):
    tracked, arrivals, codes = sequence_of(spark, range(5))
    lagged = features.training_sequences(arrivals, codes, LAYOUT).first().tokens
    aligned = features.training_sequences(arrivals, codes, LAYOUT, alignment="aligned").first().tokens
    assert list(lagged[5:15:2]) == [15, 15, 15, 15, 15]
    assert list(aligned[5:15:2]) == [15, 15, 15, 15, 15]
    _, shifted, _ = sequence_of(spark, range(5), times=[clock(43_200 + 3600 + 120 * i - 300) for i in range(5)])
    nested = trips_frame(spark, [make_trip("A", [clock(43_200 + 3600 + 120 * i - 300) for i in range(5)])])
    codes = features.encode_trips(nested, *words(spark), LAYOUT)
    lagged = features.training_sequences(shifted, codes, LAYOUT).first().tokens
    aligned = features.training_sequences(shifted, codes, LAYOUT, alignment="aligned").first().tokens
    assert list(lagged[5:15:2]) == [15, 20, 15, 15, 15]
    assert list(aligned[5:15:2]) == [20, 15, 15, 15, 15]


def test_prefix_examples_of_a_four_stop_trip(spark):
    tokens = [31, 34, 150, 160, 48, 15, 49, 17, 50, 14, 51, 16, 32] + [33] * 62
    frame = spark.createDataFrame([("A", tokens)], "trip_id string, tokens array<int>")
    rows = features.prefix_examples(frame).orderBy("place").collect()
    assert [(r.place, r.label) for r in rows] == [(7, 2.0), (9, -1.0), (11, 1.0)]
    assert rows[0].tokens == tokens[:7] + [33] * 68


def test_prefix_examples_of_a_full_row(spark):
    tokens = [31, 34, 150, 160] + [48, 15] * 35 + [32]
    frame = spark.createDataFrame([("A", tokens)], "trip_id string, tokens array<int>")
    assert features.prefix_examples(frame).count() == 34


def test_wide_table_round_trip(spark, tmp_path):
    long = [31] + list(range(120)) + [32]  # a trip of about 60 stops
    frame = spark.createDataFrame([([i] * 75,) for i in range(3)] + [(long,)], "tokens array<int>")
    features.wide_features(frame).write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert stored.select("uuid").distinct().count() == 4 and len(stored.columns) == 123
    back = [r.tokens for r in features.from_wide(stored).collect()]
    assert sorted(back) == sorted([[i] * 75 + [33] * 47 for i in range(3)] + [long])
    features.wide_features(frame.limit(2)).write.mode("append").parquet(str(tmp_path / "f"))
    both = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "f"))
    assert {len(r.tokens) for r in features.from_wide(both).collect()} == {122} and both.count() == 6


def test_a_given_width_leaves_nothing_out(spark):
    frame = spark.createDataFrame([([1] * 77,)], "tokens array<int>")
    with pytest.raises(Exception, match="more than 75 tokens: 77"):
        features.wide_features(frame, width=75).collect()


def test_shifted_pairs(spark):
    row = features.shifted_pairs(spark.createDataFrame([([1, 2, 3],)], "tokens array<int>")).first()
    assert (row.x, row.y) == ([1, 2], [2, 3])


def test_split_is_stable_and_near_its_shares(spark):
    frame = spark.range(20_000).withColumn("key", F.col("id").cast("string"))
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    first = {r.split: r["count"] for r in features.assign_split(frame, "key", shares).groupBy("split").count().collect()}
    again = features.assign_split(frame.repartition(13), "key", shares).groupBy("split").count().collect()
    assert first == {r.split: r["count"] for r in again}
    assert all(abs(first[k] / 20_000 - v) < 0.02 for k, v in shares.items())


def test_default_vocabulary_has_182_unique_tokens(spark):
    layout = Layout()
    assert (layout.stop0, layout.weekday0, layout.hour0, layout.skip, layout.size) == (48, 150, 157, 181, 182)
    rows = token_table(route_tokens(spark), stop_tokens(spark), layout).collect()
    by_token = {r.token: r.text for r in rows}
    assert sorted(by_token) == list(range(182)) and len({r.text for r in rows}) == 182
    assert by_token[0] == "d-15" and by_token[15] == "d+0" and by_token[181] == "<skp>"
    assert by_token[41] == f"{METRO_ROUTES[0]}|1" and by_token[49] == METRO_STOPS[1]


def test_unknown_names_are_listed_and_their_trips_kept_out(spark):
    trips = [make_trip("A", ["10:00:00"] * 3, places=[0, 1, 9]), make_trip("B", ["10:00:00"] * 3, route="R9")]
    nested = trips_frame(spark, trips)
    gaps = {(r.kind, r.name, r.uses) for r in features.vocabulary_gaps(nested, *words(spark)).collect()}
    assert gaps == {("stop", "S9", 1), ("route", "R9", 1)}
    assert features.encode_trips(nested, *words(spark), LAYOUT).filter("usable").count() == 0


def test_arrival_delays(spark):
    _, arrivals, _ = sequence_of(spark, [0, 1])
    nested = trips_frame(spark, [make_trip("A", [clock(43_200 + 3600 + 120 * i) for i in range(5)])])
    rows = punctuality.arrival_delays(arrivals, nested).orderBy("stop_sequence").collect()
    assert [(r.stop_sequence, r.delay_s) for r in rows] == [(1, 0), (2, 0)]
