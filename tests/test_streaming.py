import os
import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_features import LAYOUT, prepare, words
from world import Model, at, clock, make_trip, positions_frame, random_world, trips_frame

from punctual.functions.vocabulary import Layout
from punctual.operators import features, runs
from punctual.operators.model import count_tokens
from punctual.sources import readers, writers
from punctual.streaming import jobs, steps


def land(spark, folder, rows, first, last):
    """Rows of a range of seq as one landed file."""
    part = [r for r in rows if first <= r[0] < last]
    positions_frame(spark, part).coalesce(1).write.mode("append").parquet(folder)


def positions_stream(spark, folder):
    return (
        spark.readStream.schema("seq bigint, id string, lat double, lng double, trip_id string, timestamp bigint")
        .option("maxFilesPerTrigger", 1)
        .parquet(folder)
    )


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    trips, rows = random_world(21, events=600)
    nested = trips_frame(spark, trips)
    model = Model(trips, rows)
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for first in range(0, 600, 200):  # each round restarts the query from its checkpoint
        land(spark, landing, rows, first, first + 100)
        land(spark, landing, rows, first + 100, first + 200)
        jobs.run_to_end(jobs.start_arrivals(positions_stream(spark, landing), nested, out, log, True))
    got = {(r.id, r.run, r.hit): (r.seq, r.timestamp) for r in spark.read.parquet(out).collect()}
    batch = runs.first_arrivals(runs.detect_hits(positions_frame(spark, rows), nested))
    assert got == {(r.id, r.run, r.hit): (r.seq, r.timestamp) for r in batch.collect()}
    assert len(got) > 20 and model.tracked


def test_streamed_training_equals_batch(spark, tmp_path):
    trips, rows = random_world(22, events=900)
    tracked, arrivals, codes = prepare(spark, trips, rows)
    nested = trips_frame(spark, trips)
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for first in range(0, 900, 300):
        land(spark, landing, rows, first, first + 300)
        stream = positions_stream(spark, landing)
        jobs.run_to_end(jobs.start_training(stream, nested, codes, LAYOUT, out, log, available_now=True))
    got = spark.read.parquet(f"{out}/train").select("trip_id", "id", "seq", "tokens").collect()
    want = features.training_sequences(arrivals, codes, LAYOUT).select("trip_id", "id", "seq", "tokens").collect()
    assert sorted(got) == sorted(want) and len(got) > 1


def test_streamed_messages_equal_batch(spark, tmp_path):
    trips, rows = random_world(23, events=400)
    tracked, arrivals, codes = prepare(spark, trips, rows)
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for first in range(0, 400, 200):
        land(spark, landing, rows, first, first + 200)
    jobs.run_to_end(
        jobs.start_messages(
            positions_stream(spark, landing), trips_frame(spark, trips), codes, LAYOUT, out, log, available_now=True
        )
    )
    got = spark.read.parquet(f"{out}/messages").select("id", "seq", "message").collect()
    want = features.inference_messages(tracked, features.inference_sequences(tracked, arrivals, codes, LAYOUT)).collect()
    assert sorted(got) == sorted(want)


def test_predictions_are_carried_over_batches(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    train = [[31, 34, 150, 160, 48, 15, 49, 17, 50, 14, 32] + [33] * 64]
    model = count_tokens(spark.createDataFrame([(t,) for t in train], "tokens array<int>"))
    skip = LAYOUT.skip
    fresh = "v:" + ",".join(map(str, [31, 34, 150, 160, 48, 15, 49, skip, 50, skip] + [33] * 65))
    layout = Layout()
    fresh = fresh.replace(str(skip), str(layout.skip))
    for rows in ([("v", 1, "v"), ("v", 2, fresh), ("v", 3, "v")], [("v", 4, "v"), ("w", 5, "w")]):
        frame = spark.createDataFrame(rows, "id string, seq bigint, message string").coalesce(1)
        frame.write.mode("append").parquet(landing)
        stream = readers.stream_messages(spark, landing)
        jobs.run_to_end(jobs.start_predictions(stream, model, layout, out, log, True))
    made = spark.read.parquet(f"{out}/predictions").collect()
    assert [(r.id, r.seq, r.delay, r.first_predicted_sequence) for r in made] == [("v", 2, [0, 2, 1], 2 - 1)]
    sent = spark.read.parquet(f"{out}/resent").orderBy("seq").collect()
    assert [(r.id, r.seq, r.delay) for r in sent] == [("v", 3, [0, 2, 1]), ("v", 4, [0, 2, 1])]


def test_feature_table_grows_by_batches(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for i in range(2):
        spark.createDataFrame([([i] * 75,)] * 3, "tokens array<int>").write.mode("append").parquet(landing)
        stream = spark.readStream.schema("tokens array<int>").parquet(landing)
        jobs.run_to_end(jobs.start_feature_table(stream, out, log, True))
    stored = spark.read.parquet(out)
    assert stored.count() == 6 and stored.select("uuid").distinct().count() == 6


def test_feed_to_arrivals_without_ingest_numbers(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    trips, rows = random_world(25, events=200)
    stamped = [(r[0], *r[1:5], 1_700_000_000 + 3 * r[0]) for r in rows]
    frame = positions_frame(spark, stamped).drop("seq")
    numbered = readers.with_order(frame)
    nested = trips_frame(spark, trips)
    batch = runs.first_arrivals(runs.detect_hits(numbered, nested), readers.ORDER_TICKS * 60)
    frame.write.parquet(landing)
    stream = readers.with_order(spark.readStream.schema(frame.schema).parquet(landing))
    jobs.run_to_end(jobs.start_arrivals(stream, nested, out, log, True))
    columns = ["id", "run", "trip_id", "hit", "timestamp"]
    assert sorted(spark.read.parquet(out).select(*columns).collect()) == sorted(batch.select(*columns).collect())
    model = Model(trips, stamped)
    assert batch.count() == sum(1 for _ in spark.read.parquet(out).collect()) and model.tracked


def test_archive_is_replayed_as_a_stream(spark, tmp_path):
    archive, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    trips, rows = random_world(26, events=150)
    nested = trips_frame(spark, trips)
    writers.write_archive(runs.enrich(positions_frame(spark, rows), nested), archive)
    stream = readers.stream_archive(spark, archive)
    jobs.run_to_end(jobs.start_parquet(stream, out, log, True))
    assert spark.read.parquet(out).count() == sum(1 for r in rows if r[4] is not None)


def test_once_per_trip_inside_a_watermark(spark, tmp_path):
    times = [clock(50_000 + 60 * i) for i in range(3)]
    noon = 1_700_000_000 // 86_400 * 86_400 + 43_200
    rows = [at(10 * v + p, f"v{v}", "A", p, noon + 10 * v + p) for v in (1, 2) for p in range(3)]
    nested = trips_frame(spark, [make_trip("A", times)])
    codes = features.encode_trips(nested, *words(spark), LAYOUT)
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    land(spark, landing, rows, 0, 100)
    jobs.run_to_end(
        jobs.start_training_within(
            positions_stream(spark, landing), nested, codes, LAYOUT, out, log, "1 hour", available_now=True
        )
    )
    assert spark.read.parquet(out).count() == 1


def test_published_messages_and_archive(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows = [at(1, "v", "A", 0, 1), at(2, "v", None, 0, 2), at(3, "v", "nope", 0, 3)]
    land(spark, landing, rows, 0, 10)
    nested = trips_frame(spark, [make_trip("A", ["08:00:00"] * 3)])
    table = jobs.DailyTable(lambda: nested)
    for _ in range(2):
        jobs.run_to_end(jobs.start_publish(positions_stream(spark, landing), table, out, log, True))
    assert spark.read.text(f"{out}/live").count() == 2
    assert spark.read.option("header", True).csv(f"{out}/archive").count() == 2
    assert os.listdir(f"{out}/archive") == ["batch=0"]


def test_daily_table_is_read_again_after_a_day(spark):
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        return spark.range(1)

    table = jobs.DailyTable(load, clock=lambda: now[0])
    for hours in (0, 1, 24, 25, 26):
        now[0] = hours * 3600
        table.get()
    assert loads == [0.0, 25 * 3600]


def test_steps_are_chained(spark):
    rows = steps.chain(spark.range(10), lambda d: d.filter("id > 4"), lambda d: d.withColumn("x", F.col("id") * 2))
    assert sorted(r.x for r in rows.collect()) == [10, 12, 14, 16, 18]


def test_tracker_needs_no_package_in_the_worker():
    data = cloudpickle.dumps(steps.vehicle_tracker())
    load = "import pickle, sys; pickle.loads(sys.stdin.buffer.read())"
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", load], input=data, cwd="/", env=environment, check=True)
