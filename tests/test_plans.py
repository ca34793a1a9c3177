"""The shape of the physical plans: shared exchanges, pushed filters, pruned columns, no cross joins."""

import random
import re

import pytest
from pyspark.sql import functions as F
from world import at, make_trip, positions_frame, trips_frame

from punctual.operators import runs, serving, timetable
from punctual.plans import fixtures as fx
from punctual.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame):
    frame.collect()
    return plan(frame).split("Initial Plan")[0]


@pytest.fixture(scope="module")
def stage(spark):
    return fx.stage(spark, SF)


@pytest.mark.parametrize("name", ["stop_arrivals", "inference_emits", "trip_runs"])
def test_events_and_their_summary_share_one_exchange(spark, name):
    text = final_plan(QUERIES[name](spark, SF))
    assert "ReusedExchange" in text
    if name == "stop_arrivals":  # the windows over events run once: run change and run count
        assert len([x for x in text.splitlines() if " Window " in x and "timestamp" in x]) == 2


def test_flagship_reads_only_what_it_needs(spark, stage):
    text = QUERIES["stop_arrivals"](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PushedFilters: [IsNotNull(route_type), EqualTo(route_type,401)" in text
    sites = [s for s in re.findall(r"ReadSchema: (.*)", text) if "stop_lat" in s]
    assert sites and all("stop_name" not in s and "departure_time" not in s for s in sites)


def test_numbering_runs_measures_no_distance(spark, stage):
    text = plan(QUERIES["trip_runs"](spark, SF))
    assert "RADIANS" not in text and "stop_lat" not in text.split("Schema")[0]


def test_trip_lookup_is_pushed_to_the_scan(spark, stage):
    assert "EqualTo(trip_id,77)" in plan(timetable.lookup_trip(stage.trips_nested, "77"))


def test_the_two_latest_spots_are_cut_before_the_shuffle(spark, stage):
    text = plan(serving.last_moves(stage.positions))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream", "tree"))])
def test_no_query_crosses_or_collects_blindly(spark, stage, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_no_window_spans_a_vehicle(spark, stage):
    """Windows over events are keyed by (vehicle, block); the others see one row per block or folded rows."""
    tracked = runs.track_runs(runs.detect_hits(stage.positions, stage.trips_nested))
    for line in plan(tracked).split("Initial Plan")[-1].splitlines():
        if " Window " in line and "timestamp" in line:
            assert re.search(r"windowspecdefinition\(id#\d+, block#\d+L?, seq", line), line


def test_a_vehicle_with_a_third_of_the_events_is_spread(spark):
    """With small blocks the events of the hot vehicle go to many tasks of the window's exchange."""
    rng = random.Random(3)
    rows = [at(i, "hot" if i % 3 == 0 else f"v{rng.randrange(50)}", "A", i % 3, i) for i in range(9_000)]
    trips = trips_frame(spark, [make_trip("A", ["08:00:00"] * 3)])
    hits = runs.detect_hits(positions_frame(spark, rows), trips)
    blocked = runs.track_runs(hits, block_rows=300)
    spread = blocked.filter("id = 'hot'").groupBy("block").count().collect()
    assert len(spread) == 30 and max(r["count"] for r in spread) <= 300
    whole = runs.track_runs(hits)
    key = ["id", "seq", "run", "highest", "kind"]
    assert blocked.select(*key).exceptAll(whole.select(*key)).count() == 0


def test_the_trip_table_deals_the_stop_times_once_and_copies_no_list(spark):
    """The stop times were shuffled twice, and the fold of repeated trips was an aggregate over whole lists of stops."""
    nested = fx.trips_nested(spark, SF)
    written = timetable.one_row_per_trip(nested)
    text = plan(written).split("Initial Plan")[-1]
    assert "SortAggregate" not in text and "format_string" not in text
    lines = [x for x in plan(fx.stop_times(spark, SF)).splitlines() if "Exchange hashpartitioning" in x]
    assert len([x for x in lines if "REPARTITION_BY_COL" in x]) == 1 and not any("l_linenumber" in x for x in lines)
    twice = timetable.one_row_per_trip(nested.unionByName(nested)).select("trip_id", "stops")
    assert twice.exceptAll(nested.select("trip_id", "stops")).count() == 0 and twice.count() == nested.count()


def test_the_text_of_a_time_has_two_digits_at_least(spark):
    times = {0: "00:00:00", 59: "00:00:59", 60: "00:01:00", 36_000: "10:00:00", 86_399: "23:59:59", 90_061: "25:01:01", 360_000: "100:00:00"}
    frame = spark.createDataFrame([(k,) for k in times], "s bigint")
    assert {r.s: r.t for r in frame.select("s", fx.clock(F.col("s")).alias("t")).collect()} == times


def test_broken_trip_lists_are_told_in_one_read_of_the_files(spark, stage):
    text = plan(QUERIES["trip_list_rejects"](spark, SF)).split("Initial Plan")[-1]
    assert text.count("FileScan csv") == 1


def test_contents_of_a_timetable_are_shuffled_once_and_stored_once(spark, stage, tmp_path):
    from punctual.operators.versions import fold_versions
    from punctual.streaming.engine import VersionedTimetable

    trips = stage.trips_nested.limit(50).localCheckpoint()
    table = VersionedTimetable(spark, str(tmp_path))
    for valid_from in (0, 100):
        table.publish(trips.withColumn("shape_id", F.lit(valid_from).cast("bigint")), valid_from)
    kept = [spark.read.parquet(f"{row['path']}/snapshots").count() for row in table.registry.pointers().collect()]
    assert kept == [50, 50]  # the second does not repeat the first
    assert table.get()[0].groupBy("valid_from", "valid_to").count().orderBy("valid_from").collect() == [(0, 100, 50), (100, None, 50)]
    snapshots = spark.read.parquet(*[f"{row['path']}/snapshots" for row in table.registry.pointers().collect()])
    assert plan(fold_versions(snapshots)).split("Initial Plan")[-1].count("Exchange") == 1


@pytest.mark.parametrize("name", ["features", "messages", "answers"])
def test_small_staged_tables_are_read_by_several_tasks(stage, name):
    assert len(getattr(stage, name).inputFiles()) > 1


@pytest.mark.parametrize("name", ["training_gate", "delay_tokens", "train_sequences", "infer_sequences", "infer_messages"])
def test_sequences_measure_no_stop_anew(spark, stage, name):
    text = plan(QUERIES[name](spark, SF))
    assert "RADIANS" not in text and "lag(" not in text


def test_the_first_padding_is_looked_for_once_a_sequence(spark):
    """Inside the lambda over the places it was looked for at every place."""
    from punctual.functions.vocabulary import PAD
    from punctual.operators.features import prefix_examples

    rows = [("a", list(range(9, 14)) + [PAD] * 5), ("b", list(range(40, 50))), ("c", [7] * 9), ("d", [1] * 7), ("e", [1] * 7 + [PAD] * 3), ("f", [])]
    frame = spark.createDataFrame(rows, "trip_id string, tokens array<int>")
    made = prefix_examples(frame)
    got = {(r.trip_id, r.place): (r.tokens, r.label) for r in made.collect()}
    assert got == {
        ("b", 7): ([*range(40, 47), PAD, PAD, PAD], 32.0), ("b", 9): ([*range(40, 49), PAD], 34.0), ("c", 7): ([7] * 7 + [PAD] * 2, -8.0)
    }
    assert "< coalesce(array_min" not in plan(made)


def test_the_loss_holds_the_joins_of_one_level_in_a_task(spark, stage):
    loss = QUERIES["next_token_loss"](spark, SF)
    assert plan(loss).split("Initial Plan")[-1].count("Join") == 0  # what is left after the last level is a sum


def test_the_repeated_predictions_are_decoded_once_and_bare_ids_split_no_list(spark, stage):
    """The blocks' last answers were folded from a second scan, and every list of tokens was split to find the bare ids."""
    text = final_plan(QUERIES["resend_predictions"](spark, SF))
    assert "ReusedExchange" in text and text.count("FileScan parquet [id") == 1 and "split(" not in text


def test_metro_trips_made_alone_are_those_of_the_trip_table(spark, stage, tmp_path):
    """Stop detection and sequences had all trips nested, with all their fields, to read the metro trips."""
    alone = fx.Stage(spark, SF)
    got = alone.metro_trips
    assert "trips_nested" not in alone.__dict__ and alone.metro.count() == stage.metro.count()
    fields = ("stop_sequence", "stop_name", "arrival_time", "stop_lat", "stop_lon")
    stops = F.transform("stops", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("stops")
    want = stage.trips_nested.filter("route_type = 401 and stops is not null").select(*got.columns[:-1], stops)
    assert got.dtypes == want.dtypes and got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    text = plan(fx.metro_trips(spark, SF))
    lists = [x for x in text.splitlines() if "Exchange hashpartitioning" in x]
    assert len(lists) == 3 and "o_orderpriority" not in text  # lines, and the trips for the choice and for the result
    for name in ("orders", "customer", "lineitem", "supplier", "nation"):  # every trip and line twice, and a trip without lines
        frame = fx.table(spark, SF, name)
        twice = frame.unionByName(frame) if name in ("orders", "lineitem") else frame
        if name == "lineitem":
            twice = twice.filter("l_orderkey % 10 != 3")
        twice.write.parquet(f"{tmp_path}/{name}.parquet")
    want = want.filter("trip_id % 10 != 3")
    got = fx.metro_trips(spark, str(tmp_path))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("name", ["stop_arrivals", "enriched_positions"])
def test_what_needs_all_trips_makes_no_metro_trips_apart(spark, monkeypatch, name):
    own = fx.Stage(spark, SF)
    monkeypatch.setattr(fx, "stage", lambda spark, d: own)
    QUERIES[name](spark, SF)
    assert "trips_nested" in own.__dict__ and "_metro_trips" not in own.__dict__


def test_coarser_counts_are_folded_once_from_stored_ones(spark, stage):
    """Every reader of a coarser table folded it anew from the most specific one."""
    texts = [plan(t) for t in stage.counts]
    assert len(texts) == 4 and all("Aggregate" not in text and "FileScan parquet" in text for text in texts)
    sums = [t.agg(F.sum("n")).first()[0] for t in stage.counts]
    assert len(set(sums)) == 1 and sums[0] > 0


def test_the_newest_model_is_published_without_its_loss(spark, monkeypatch):
    """The loss on held-out sequences was measured for both models, though the job takes the newest one whatever its loss."""
    from punctual.streaming import views

    own = fx.Stage(spark, SF)
    monkeypatch.setattr(views, "cross_entropy", lambda *rest: pytest.fail("the loss was measured"))
    newest = own.unmeasured_models.newest()
    assert own.unmeasured_models.registry.pointers().count() == 2 and own.unmeasured_models.registry.best("loss") is None
    assert "trips_nested" not in own.__dict__
    for stored, table in zip(newest, own.counts):
        assert stored.exceptAll(table).count() == 0 and stored.count() == table.count()
    own.__dict__["models"] = published = object()
    del own.__dict__["unmeasured_models"]
    assert own.unmeasured_models is published  # what has been published with losses is not published again
