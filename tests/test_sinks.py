"""Rolling archive, ordered replay, feature groups, and feeds with a quarantine."""

import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F
from test_streaming import land, positions_stream
from world import at, make_trip, positions_frame, random_world, trips_frame

from punctual.operators import model, runs
from punctual.operators.timetable import one_row_per_trip
from punctual.sources import readers, writers
from punctual.streaming import jobs


def sizes(folder):
    """Rows of every archive file, by name."""
    out = {}
    for path in sorted(glob.glob(f"{folder}/**/*.csv.gz", recursive=True)):
        with gzip.open(path, "rt") as f:
            out[os.path.relpath(path, folder)] = sum(1 for _ in f) - 1
    return out


def test_archive_rolls_by_rows_and_by_idle_time(spark, tmp_path):
    trips, rows = random_world(41, events=700)
    nested = trips_frame(spark, trips)
    known = sorted(r[0] for r in rows if r[4] is not None)
    now = [0.0]
    landing, folder, log = (str(tmp_path / n) for n in ("in", "roll", "log"))
    table, last = jobs.DailyTable(lambda: nested), -1
    for first, end in ((0, 60), (60, 130), (130, 600), (600, 610), (610, 700)):
        archive = jobs.rolling_archive(spark, folder, 100, 30.0, clock=lambda: now[0])  # a restart each time
        land(spark, landing, rows, first, end)
        jobs.run_to_end(jobs.start_rolling_archive(positions_stream(spark, landing), table, archive, log, True))
        last, now[0] = last + 1, now[0] + 10
        assert not archive.close_idle(last)
    assert archive.close_idle(last, now=now[0] + 100)
    held = sizes(f"{folder}/closed")
    assert sum(held.values()) == len(known)
    assert all(n >= 100 for n in list(held.values())[:-1]) and max(held.values()) < 200 + 100
    assert sum(r.rows for r in archive.groups().collect()) == len(known)
    back = readers.replay_in_order(spark, f"{folder}/closed").orderBy("seq").collect()
    stamp = {r[0]: (r[1], r[5]) for r in rows}
    assert [r.seq for r in back] == list(range(1, len(known) + 1))
    assert [(r.id, r.timestamp) for r in back] == [stamp[k] for k in known]


def test_rolled_group_keeps_every_row_when_its_ranges_are_many_tasks(spark, tmp_path, monkeypatch):
    """Narrow sizes and wide rows coalesce to different partitions: ranks taken from both lost most of the rows."""
    monkeypatch.setattr(writers, "RANGE_ROWS", 7_000, raising=False)
    n = 40_000
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in readers.schemas.ARCHIVE.fields if f.name not in ("id", "timestamp")]
    mixed = F.when(F.col("id") > 0, F.col("id") * 7919 % n).alias("seq")  # the one without a number comes first
    rows = spark.range(0, n, 1, 8).select(mixed, F.sha2(F.col("id").cast("string"), 512).alias("id"), F.col("id").alias("timestamp"), *empty)
    small = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "300k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        writers.write_rolled(rows, str(tmp_path), 0, n, 5_000)
        back = readers.replay_in_order(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        for key in small:
            spark.conf.unset(key)
    assert list(sizes(tmp_path).values()) == [5_000] * 8
    assert [r.seq for r in back] == list(range(1, n + 1))
    assert [r.timestamp for r in back] == sorted(range(n), key=lambda i: i * 7919 % n if i else -1)


def test_replay_from_a_later_file_reads_only_from_there(spark, tmp_path):
    nested = trips_frame(spark, [make_trip("A", ["08:00:00"] * 3)])
    rows = [at(i, f"v{i % 3}", "A" if i % 2 else "nope", 0, 1_700_000_000 + i) for i in range(130)]
    enriched = runs.enrich(positions_frame(spark, rows), nested, drop_stops=True)
    for group in range(12):
        part = enriched.filter(F.floor(F.col("seq") / 10) == group)
        writers.write_rolled(part.select("seq", *writers.archive_rows(part).columns), str(tmp_path), group, 10, 4)
    assert [n for n in sizes(tmp_path).values()] == [4, 6] * 12
    files = readers.archive_files(spark, str(tmp_path)).orderBy("file_ix").collect()
    assert [r.file_ix for r in files] == list(range(24)) and [r.uri for r in files] == sorted(r.uri for r in files)
    for start, first in ((0, 0), (1, 4), (2, 10), (23, 114), (24, 120)):
        got = readers.replay_in_order(spark, str(tmp_path), start).orderBy("seq").collect()
        assert [(r.seq, r.timestamp - 1_700_000_000) for r in got] == [(k + 1, first + k) for k in range(120 - first)]
    plan = readers.replay_in_order(spark, str(tmp_path), 23)._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in plan and "Python" not in plan


def test_rolled_files_hold_the_rows_in_order(spark, tmp_path):
    rows = positions_frame(spark, [at(7 * i % 1000, "v", "A", 0, i) for i in range(1000)])
    enriched = runs.enrich(rows, trips_frame(spark, []), drop_stops=True)
    writers.write_rolled(enriched.select("seq", *writers.archive_rows(enriched).columns), str(tmp_path), 3, 1000, 300)
    assert [*sizes(tmp_path).values()] == [300, 300, 400] and all("group=000000003" in p for p in sizes(tmp_path))
    writers.write_rolled(enriched.limit(0).select("seq", *writers.archive_rows(enriched).columns), str(tmp_path), 4, 0, 300)
    assert sum(sizes(tmp_path).values()) == 1000


def test_feature_groups_of_ten_or_more(spark, tmp_path):
    now, folder, landing, log = [0.0], *(str(tmp_path / n) for n in ("f", "in", "log"))
    groups = jobs.feature_groups(spark, folder, 30.0, clock=lambda: now[0])
    n = 0
    for size in (4, 3, 12, 1, 9, 2):
        spark.createDataFrame([([n + k] * 75, "x") for k in range(size)], "tokens array<int>, trip_id string").coalesce(1).write.mode("append").parquet(landing)
        n += size
        stream = spark.readStream.schema("tokens array<int>, trip_id string").parquet(landing)
        jobs.run_to_end(jobs.start_feature_groups(stream, groups, log, True))
        now[0] += 10
    stored = spark.read.parquet(f"{folder}/features")
    assert sorted(r["count"] for r in stored.groupBy("group").count().collect()) == [10, 19]
    assert groups.close_idle(5, now=now[0] + 100)
    stored = spark.read.parquet(f"{folder}/features")
    assert sorted(r.feature_00 for r in stored.collect()) == list(range(n)) and stored.select("uuid").distinct().count() == n
    assert sorted(r["count"] for r in stored.groupBy("group").count().collect()) == [2, 10, 19]


def entity(**leave_out):
    whole = {"trip": {"trip_id": "A"}, "vehicle": {"id": "v"}, "position": {"latitude": 1.0, "longitude": 2.0}, "timestamp": 5}
    return {"vehicle": {k: v for k, v in whole.items() if not leave_out.get(k)}}


def test_feeds_are_parted_and_counted_in_one_read(spark, tmp_path):
    landing, folder, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    batches = [
        [json.dumps({"entity": [entity(), entity(position=1), entity(trip=1)]}), '{"entity": [{"veh', "no json"],
        [json.dumps({"entity": []}), json.dumps({}), json.dumps({"entity": [entity(vehicle=1), entity(timestamp=1), entity()]}), "\x00"],
    ]
    for k, lines in enumerate(batches):
        os.makedirs(f"{landing}/agency={k}")
        with open(f"{landing}/agency={k}/part.json", "w") as f:
            f.write("\n".join(lines))
        jobs.run_to_end(jobs.start_feed_sinks(readers.stream_feeds(spark, landing), folder, log, True))
    counts = [tuple(r) for r in spark.read.parquet(f"{folder}/counts").orderBy("batch").drop("batch").collect()]
    assert counts == [(3, 2, 3, 1, 2), (4, 1, 3, 2, 1)]
    assert spark.read.parquet(f"{folder}/positions").count() == 3
    assert sorted(r.payload for r in spark.read.parquet(f"{folder}/broken").collect()) == sorted([batches[0][1], "no json", "\x00"])
    assert all("vehicle" in json.loads(r.payload) for r in spark.read.parquet(f"{folder}/incomplete").collect())


def test_repeated_messages_are_each_filled(spark):
    train = [[31, 34, 150, 160, 48, 15, 49, 17, 50, 14, 32] + [33] * 64]
    from punctual.functions.vocabulary import Layout

    layout = Layout()
    counts = model.count_tokens(spark.createDataFrame([(t,) for t in train], "tokens array<int>"))
    ask = [31, 34, 150, 160, 48, 15, 49, layout.skip, 50, layout.skip] + [33] * 65
    other = [31, 34, 150, 160, 48, 15, 50, layout.skip] + [33] * 67
    rows = [("v", 1, ask), ("v", 1, ask), ("v", 1, other), (None, None, ask), (None, None, ask)]
    got = model.fill_sequences(counts, spark.createDataFrame(rows, "id string, seq bigint, tokens array<int>"), layout).collect()
    assert len(got) == 5
    assert sorted(str(r.answer[:10]) for r in got) == sorted([str(train[0][:10])] * 4 + [str([31, 34, 150, 160, 48, 15, 50, 14])])


def test_a_repeated_trip_is_written_once(spark, tmp_path):
    trips = [make_trip("A", ["08:00:00"] * 3), make_trip("A", ["09:00:00"] * 3), make_trip("B", [])]
    writers.write_trip_table(trips_frame(spark, trips), str(tmp_path / "t"))
    assert sorted(r.trip_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["A", "B"]
    newer = trips_frame(spark, trips).withColumn("v", F.monotonically_increasing_id())
    assert one_row_per_trip(newer, "v").filter("trip_id = 'A'").first().stops[0].arrival_time == "09:00:00"


def test_a_bad_row_fails_the_ordered_replay(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write(",".join(readers.schemas.ARCHIVE.fieldNames()) + "\nv,18.0,59.0,notatime,A,401,SL,,,,1,0\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parsing"):
        readers.replay_in_order(spark, str(tmp_path)).collect()
