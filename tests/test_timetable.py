from pyspark.sql import functions as F
from world import make_trip, trips_frame

from punctual.operators import timetable
from punctual.schemas import TRIP_LISTS
from punctual.sources import readers, writers


def small_feed(tmp_path):
    files = {
        "trips": "route_id,service_id,trip_id,trip_headsign,direction_id,shape_id\nr1,1,10,x,0,7\nr2,1,11,x,1,8\nr9,1,12,x,1,9\n",
        "routes": "route_id,agency_id,route_short_name,route_long_name,route_type,route_desc\nr1,1,13,Red,401,d\nr2,2,55,,700,d\n",
        "agency": "agency_id,agency_name,agency_url,agency_timezone,agency_lang,agency_fare_url\n1,SL,u,t,l,f\n",
        # Columns in another order than usual, rows out of order, the first stop without headsign.
        "stop_times": "trip_id,stop_id,stop_sequence,arrival_time,departure_time,stop_headsign,shape_dist_traveled,pickup_type\n"
        "10,s2,2,08:05:00,08:05:30,Mörby,200.5,0\n10,s1,1,08:00:00,08:00:30,,0,0\n11,s1,1,25:00:00,25:00:30,B,0,0\n",
        "stops": "stop_id,stop_name,stop_lat,stop_lon\ns1,One,59.1,18.1\ns2,Two,59.2,18.2\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(tmp_path)


def nested_feed(spark, tmp_path):
    t = readers.read_timetable(spark, small_feed(tmp_path))
    return timetable.nest_trips(t["trips"], t["routes"], t["agency"], t["stop_times"], t["stops"])


def test_csv_files_to_nested_trips(spark, tmp_path):
    rows = {r.trip_id: r for r in nested_feed(spark, tmp_path).collect()}
    assert [s.stop_name for s in rows["10"].stops] == ["One", "Two"]
    assert rows["10"].trip_headsign == "Mörby" and rows["10"].agency_name == "SL"
    assert rows["11"].agency_id == 2 and rows["11"].agency_name is None and rows["11"].stops[0].arrival_time == "25:00:00"
    assert rows["12"].stops is None and rows["12"].route_type is None


def test_pipe_lists_and_back(spark, tmp_path):
    nested = nested_feed(spark, tmp_path)
    lists = timetable.to_pipe_lists(nested)
    row = lists.filter("trip_id = '10'").first()
    assert (row.stop_id, row.stop_lat, row.stop_sequence) == ("s1|s2", "59.1|59.2", "1|2")
    good, bad = timetable.from_pipe_lists(lists)
    assert bad.count() == 0
    assert sorted(good.collect()) == sorted(nested.collect())


def test_gzip_interchange_files(spark, tmp_path):
    nested = trips_frame(spark, [make_trip("A", ["08:00:00"] * 3), make_trip("B", [])])
    folder = str(tmp_path / "lists")
    writers.write_trip_lists(nested, folder)
    good, bad = readers.read_trip_lists(spark, folder)
    assert bad.count() == 0 and sorted(good.collect()) == sorted(nested.collect())


def test_unequal_or_unreadable_lists_go_to_quarantine(spark):
    def row(trip, **lists):
        base = dict(stop_id="a|b", stop_name="A|B", stop_lat="1|2", stop_lon="1|2", stop_sequence="1|2",
                    arrival_time="x|y", departure_time="x|y", shape_dist_traveled="0|1")
        base.update(lists)
        return (trip, 1, "r", 0, 401, "s", "l", "h", 1, "a", *[base[c] for c in TRIP_LISTS.fieldNames()[10:]])

    rows = [row("ok"), row("short", stop_name="A"), row("text", stop_lat="1|z"), row("lost", arrival_time=None)]
    good, bad = timetable.from_pipe_lists(spark.createDataFrame(rows, TRIP_LISTS))
    assert [r.trip_id for r in good.collect()] == ["ok"]
    assert sorted(r.trip_id for r in bad.collect()) == ["lost", "short", "text"]


def test_duplicate_trips_keep_the_newest(spark):
    one = trips_frame(spark, [make_trip("A", ["08:00:00"] * 3)]).withColumn("v", F.lit(1))
    two = trips_frame(spark, [make_trip("A", ["09:00:00"] * 2)]).withColumn("v", F.lit(2))
    row = timetable.one_row_per_trip(one.unionByName(two), "v").first()
    assert len(row.stops) == 2 and row.v == 2


def test_lookup_and_compact_stops(spark):
    nested = trips_frame(spark, [make_trip("A", ["08:00:00"] * 3)])
    assert timetable.lookup_trip(nested, "A").count() == 1
    assert timetable.lookup_trip(nested, "Z").count() == 0
    stop = timetable.compact_stops(nested).first().stops[0]
    assert sorted(stop.asDict()) == ["arrival_time", "stop_lat", "stop_lon", "stop_name", "stop_sequence"]
