import gzip
import json
import os

import pytest
from world import at, make_trip, positions_frame, trips_frame

from punctual.operators import runs, serving
from punctual.sources import readers, writers


def entity(name="v", trip="A", lat=59.0, ts=10, **changes):
    body = {
        "trip": None if trip is None else {"trip_id": trip} if trip else {},
        "vehicle": {"id": name},
        "position": {"latitude": lat, "longitude": 18.0},
        "timestamp": ts,
    }
    body.update(changes)
    return {"vehicle": {k: v for k, v in body.items() if v is not None}}


def land(folder, agency, name, *lines):
    os.makedirs(f"{folder}/agency={agency}", exist_ok=True)
    with open(f"{folder}/agency={agency}/{name}.json", "w", encoding="utf-8") as f:
        f.write("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))


def test_feeds_of_all_agencies_are_flattened(spark, tmp_path):
    folder = str(tmp_path)
    land(folder, "sl", "a", {"entity": [entity("v1"), entity("v2", trip=None), entity("v3", trip="")]})
    land(folder, "ul", "a", {"entity": [entity("v4"), entity("v5", timestamp=None), entity("v6", position=None)]})
    land(folder, "ul", "b", {"entity": [entity("v7", vehicle=None), {"vehicle": None}]}, "{not json", {"entity": []})
    feeds = readers.read_feeds(spark, folder)
    got = {(r.agency, r.id): r.trip_id for r in readers.flatten_feed(feeds).collect()}
    assert got == {
        ("sl", "v1"): "A", ("sl", "v2"): None, ("sl", "v3"): "", ("ul", "v4"): "A",
    }
    assert [(r.agency, r.payload) for r in readers.quarantined(feeds).collect()] == [("ul", "{not json")]


def test_feed_stream_sees_new_files(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(folder, "sl", "a", {"entity": [entity("v1")]})
    land(folder, "ul", "b", {"entity": [entity("v2")]})

    def run():
        flat = readers.flatten_feed(readers.stream_feeds(spark, folder, max_files=1))
        job = flat.writeStream.format("parquet").option("checkpointLocation", f"{out}/log")
        job.trigger(availableNow=True).start(f"{out}/data").awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{out}/data").collect())

    assert run() == ["v1", "v2"]
    land(folder, "sl", "c", {"entity": [entity("v3")]})
    assert run() == ["v1", "v2", "v3"]


def test_union_of_feeds(spark):
    frames = [positions_frame(spark, [at(i, f"v{i}", "A", 0, 1)]) for i in range(3)]
    assert readers.union_feeds(*frames).count() == 3


def enriched(spark, count=25):
    rows = [at(i, f"v{i % 3}", "A" if i % 2 else "nope", 0, 1_700_000_000 + i * 20_000) for i in range(count)]
    return runs.enrich(positions_frame(spark, rows), trips_frame(spark, [make_trip("A", ["08:00:00"] * 3)]))


def test_archive_round_trip_in_order(spark, tmp_path):
    frame, folder = enriched(spark), str(tmp_path / "archive")
    writers.write_archive(frame, folder)
    back = readers.replay_archive(spark, folder, start=0).orderBy("seq").collect()
    want = frame.orderBy("seq").collect()
    assert [(r.id, r.timestamp, r.trip_id) for r in back] == [(r.id, r.timestamp, r.trip_id) for r in want]
    assert len({r.seq for r in back}) == len(back)
    files = readers.archive_files(spark, folder)
    assert files.count() >= 6  # one date each, or more
    skipped = [r for r in back if r.seq < 2 * readers.FILE_STRIDE]
    later = readers.replay_archive(spark, folder, start=2).orderBy("seq").collect()
    assert 0 < len(skipped) and later == back[len(skipped) :]


def test_archive_rows_have_null_metadata_for_unknown_trips(spark):
    row = writers.archive_rows(enriched(spark)).filter("trip_id = 'nope'").first()
    assert row.route_type is None and row.agency_name is None and len(row) == 12


def test_a_bad_archive_row_fails_the_replay(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write(",".join(readers.schemas.ARCHIVE.fieldNames()) + "\nv,18.0,59.0,notatime,A,401,SL,,,,1,0\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parsing"):
        readers.replay_archive(spark, str(tmp_path), start=0).collect()


def test_live_messages_leave_out_an_unknown_route_type(spark):
    got = [json.loads(r.value) for r in serving.live_json(enriched(spark, 2)).collect()]
    assert sorted(map(len, got)) == [4, 5] and {g.get("route_type") for g in got} == {None, 401}


def test_malformed_position_messages_are_skipped(spark):
    good = '{"id":"v","lat":1.0,"lng":2.0,"trip_id":"A","timestamp":5}'
    rows = spark.createDataFrame([(good,), ("{oops",), ('{"id":"v"}',)], "value string")
    assert [(r.id, r.timestamp) for r in readers.parse_positions(rows).collect()] == [("v", 5)]


def test_token_csv_without_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\n".join(",".join(str(i + k) for i in range(75)) for k in range(2)))
    assert sorted(r.tokens[0] for r in readers.read_token_csv(spark, str(tmp_path)).collect()) == [0, 1]


def test_token_csv_of_any_length(spark, tmp_path):
    rows = spark.createDataFrame([(list(range(n)),) for n in (1, 80, 200)] + [([],)], "tokens array<int>")
    writers.write_token_csv(rows, str(tmp_path / "t"))
    got = [r.tokens for r in readers.read_token_csv(spark, str(tmp_path / "t")).collect()]
    assert sorted(got, key=len) == [list(range(n)) for n in (1, 80, 200)]
    (tmp_path / "bad.csv").write_text("1,2,x")
    with pytest.raises(Exception, match="not a line of tokens"):
        readers.read_token_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_features_by_mode(spark, tmp_path):
    rows = spark.createDataFrame([("A", "train"), ("B", "infer")], "trip_id string, mode string")
    writers.write_features(rows, str(tmp_path / "f"))
    assert os.path.isdir(tmp_path / "f" / "mode=train")
    assert spark.read.parquet(str(tmp_path / "f")).filter("mode = 'infer'").first().trip_id == "B"


def test_order_without_ingest_numbers(spark):
    rows = [("v", 1.0 + k % 3, 2.0, "A", 100 + k // 6) for k in range(3000)] * 2 + [("w", 1.0, 2.0, None, 100)]
    frame = spark.createDataFrame(rows, "id string, lat double, lng double, trip_id string, timestamp long")
    got = readers.with_order(frame).collect()
    assert len(got) == 1501 and len({(r.id, r.seq) for r in got}) == 1501
    assert all(r.seq // readers.ORDER_TICKS == r.timestamp for r in got)
    assert len({r.seq >> 20 for r in got}) == 1  # a block of the ordered operators holds all 500 seconds
