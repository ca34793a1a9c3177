"""The one-pass engine, timetable versions, and what batches leave to each other."""

import os

import pytest
from pyspark.sql import functions as F
from test_features import LAYOUT, prepare, words
from test_streaming import land, positions_stream
from world import at, clock, make_trip, positions_frame, random_world, trips_frame

from punctual.operators import features, runs, versions
from punctual.streaming import engine, jobs, keyed


def split_state(spark, rows, nested, cuts, block_rows):
    """Tracked events and arrivals of ``rows`` taken in pieces, with the state carried from one to the next."""
    state = spark.createDataFrame([], runs.STATE_SCHEMA)
    tracked, arrivals = [], []
    for first, last in zip(cuts, cuts[1:]):
        hits = runs.detect_hits(positions_frame(spark, [r for r in rows if first <= r[0] < last]), nested)
        here = state.join(hits.select("id").distinct(), "id", "left_semi")
        part = runs.track_runs(hits, block_rows, state=here).cache()
        reached = runs.reached_so_far(part, here).cache()
        tracked += [(r.id, r.seq, r.trip_id, r.run, r.highest, r.kind) for r in part.collect()]
        arrivals += [tuple(r) for r in runs.new_arrivals(reached).select("id", "run", "trip_id", "hit", "seq", "timestamp").collect()]
        fresh = runs.next_state(part, reached, here)
        state = spark.createDataFrame(state.join(fresh, "id", "left_anti").unionByName(fresh).collect(), runs.STATE_SCHEMA)
    return sorted(tracked), sorted(arrivals)


@pytest.mark.parametrize("seed, cuts, block_rows", [(1, [0, 200, 400, 600], 1 << 20), (2, [0, 1, 2, 90, 300, 600], 16), (3, [0, 333, 600], 7)])
def test_events_in_pieces_give_the_same(spark, seed, cuts, block_rows):
    trips, rows = random_world(seed)
    nested = trips_frame(spark, trips)
    tracked, arrivals = split_state(spark, rows, nested, cuts, block_rows)
    whole = runs.track_runs(runs.detect_hits(positions_frame(spark, rows), nested))
    assert tracked == sorted((r.id, r.seq, r.trip_id, r.run, r.highest, r.kind) for r in whole.collect())
    first = runs.first_arrivals(runs.detect_hits(positions_frame(spark, rows), nested))
    assert arrivals == sorted(tuple(r) for r in first.select("id", "run", "trip_id", "hit", "seq", "timestamp").collect())
    assert arrivals == sorted(tuple(r) for r in runs.arrivals_of(whole).select("id", "run", "trip_id", "hit", "seq", "timestamp").collect())


def test_one_pass_gives_all_outputs_over_batches_and_restarts(spark, tmp_path):
    trips, rows = random_world(31, events=900)
    nested = trips_frame(spark, trips)
    tracked, arrivals, codes = prepare(spark, trips, rows)
    landing, out, log, log2, train = (str(tmp_path / n) for n in ("in", "out", "log", "log2", "train"))
    table = engine.FixedTimetable(nested, codes)
    for first in range(0, 900, 300):
        land(spark, landing, rows, first, first + 150)
        land(spark, landing, rows, first + 150, first + 300)
        job = engine.Engine(table, out, engine.OUTPUTS, LAYOUT, block_rows=50)
        jobs.run_to_end(job.start(positions_stream(spark, landing), log, True))
        jobs.run_to_end(engine.start_training_rows(spark, f"{out}/gates", table, LAYOUT, train, log2, True))
    assert len(os.listdir(f"{out}/arrivals")) == 6  # one file a batch
    columns = ["id", "run", "trip_id", "n_stops", "hit", "seq", "timestamp"]
    got = spark.read.parquet(f"{out}/arrivals").select(*columns).collect()
    assert sorted(got) == sorted(arrivals.select(*columns).collect()) and len(got) > 20
    want = features.inference_messages(tracked, features.inference_sequences(tracked, arrivals, codes, LAYOUT))
    assert sorted(spark.read.parquet(f"{out}/messages").select("id", "seq", "message").collect()) == sorted(want.collect())
    want = features.training_sequences(arrivals, codes, LAYOUT).select("trip_id", "id", "seq", "tokens").collect()
    assert sorted(spark.read.parquet(train).select("trip_id", "id", "seq", "tokens").collect()) == sorted(want) and len(want) > 1
    known = [r for r in rows if r[4] is not None]
    assert spark.read.text(f"{out}/live").count() == len(known)
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/archive").collect()) == sorted(r[0] for r in known)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    trips, rows = random_world(32, events=200)
    nested = trips_frame(spark, trips)
    job = engine.Engine(engine.FixedTimetable(nested), str(tmp_path / "out"))
    parts = [positions_frame(spark, [r for r in rows if a <= r[0] < a + 100]) for a in (0, 100)]
    job.write(parts[0], 0)
    job.write(parts[1], 1)
    once = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/arrivals")).collect())
    job.write(parts[1], 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/arrivals")).collect()) == once


def test_no_python_in_the_plan_and_windows_inside_blocks(spark):
    trips, rows = random_world(33, events=50)
    state = spark.createDataFrame([], runs.STATE_SCHEMA)
    tracked = runs.track_runs(runs.detect_hits(positions_frame(spark, rows), trips_frame(spark, trips)), state=state)
    reached = runs.reached_so_far(tracked, state)
    for frame in (tracked, runs.new_arrivals(reached), runs.next_state(tracked, reached, state), engine.opened_gates(reached)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_engine_refuses_unknown_outputs(spark, tmp_path):
    table = engine.FixedTimetable(None)
    for bad in ({"outputs": ("maps",)}, {"outputs": ()}, {"outputs": ("messages",)}):
        with pytest.raises(ValueError):
            engine.Engine(table, str(tmp_path), **bad)


def test_a_trip_is_emitted_once_for_ever_at_a_flat_cost(spark, tmp_path):
    """Forty batches, each with old trips and new ones: every trip once, and the state holds one mark a trip."""
    gates, out, log = (str(tmp_path / n) for n in ("gates", "out", "log"))
    times = [clock(50_000 + 60 * i) for i in range(3)]
    trips = [make_trip(f"t{k}", times) for k in range(45)]
    nested = trips_frame(spark, trips)
    table = engine.FixedTimetable(nested, features.encode_trips(nested, *words(spark), LAYOUT))
    ddl = "id string, run bigint, trip_id string, n_stops int, seq bigint, timestamp bigint, times array<bigint>"
    for k in range(40):
        rows = [(f"v{j}", k, f"t{j}", 3, 100 * k + 40 - j, 1_700_000_000, [1, 2, 3]) for j in range(k, max(-1, k - 5), -1)]
        rows += [("w", k, f"t{k}", 3, 100 * k + 90, 1_700_000_000, [1, 2, 3])]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{gates}/batch={k}")
        if k % 10 == 9:
            query = engine.start_training_rows(spark, gates, table, LAYOUT, out, log, True)
            jobs.run_to_end(query)
            if query.lastProgress and query.lastProgress["stateOperators"]:
                assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * (k + 1)
    got = spark.read.parquet(out).select("trip_id", "id").collect()
    assert sorted(r.trip_id for r in got) == sorted(f"t{k}" for k in range(40))
    assert all(r.id == f"v{r.trip_id[1:]}" for r in got)  # the lowest seq of the first batch


def test_first_gates_need_no_python(spark, tmp_path):
    """A trip's mark is kept by Spark's own state: Python was called once a trip."""
    ddl = "id string, run bigint, trip_id string, n_stops int, seq bigint, timestamp bigint, times array<bigint>"
    rows = [("v", 0, "a", 3, 9, 9, [1, 2, 3]), ("w", 1, "a", 3, 4, 4, [4, None, 6]), ("w", 2, "b", 3, 5, 5, [7, 8, 9])]
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "in"))
    stream = engine.first_of_each_trip(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")))
    got = []

    def write(batch, batch_id):
        got.extend(tuple(r) for r in batch.collect())

    query = jobs.start_batches(stream, write, str(tmp_path / "log"), True, "update")
    jobs.run_to_end(query)
    plan = query._jsq.explainInternal(True)
    assert sorted(got) == [("w", 1, "a", 3, 4, 4, [4, None, 6]), ("w", 2, "b", 3, 5, 5, [7, 8, 9])]
    assert "StateStoreSave" in plan and not any(name in plan for name in ("Python", "Pandas", "PySpark"))


# ---- keyed rows, pools, versions of files ---------------------------------------------------------------------------


def test_keyed_table_keeps_the_last_row_of_every_key(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "id", "id string, n bigint, x array<int>", every=3)
    now = {}
    for b in range(11):
        assert {r.id: (r.n, r.x) for r in table.before(b).collect()} == now
        rows = [(f"k{j}", b * 10 + j, [b] if j else None) for j in range(b % 4, b % 4 + 2)] if b != 5 else []
        for _ in range(2):  # a repeated batch replaces itself
            table.put(b, spark.createDataFrame(rows, "id string, n bigint, x array<int>"))
        now |= {r[0]: r[1:] for r in rows}
    assert {r.id: (r.n, r.x) for r in table.before(11).collect()} == now
    held = sum(spark.read.schema(table.schema).parquet(f"{tmp_path}/t/changed={b}").count() for b in range(3))
    assert held == 0  # parts that are in two whole tables are emptied


def test_pool_gives_groups_of_enough_rows_each_row_once(spark, tmp_path):
    given, clock_ = {}, [0.0]

    def give(df, group, rows):
        given[group] = sorted(r.x for r in df.collect())
        assert len(given[group]) == rows

    pool = keyed.Pool(spark, str(tmp_path / "p"), "x int", 10, 60.0, give, clock=lambda: clock_[0])
    sizes, x = [3, 0, 4, 2, 1, 25, 0, 9, 9, 2], 0
    for b, n in enumerate(sizes):
        rows = [(x + k,) for k in range(n)]
        for _ in range(1 + b % 2):
            pool.add(spark.createDataFrame(rows, "x int"), b)
        x += n
        clock_[0] += 10
    assert not pool.close_idle(len(sizes) - 1)
    assert pool.close_idle(len(sizes) - 1, now=clock_[0] + 100) and not pool.close_idle(len(sizes) - 1, now=clock_[0] + 900)
    assert sorted(v for g in given.values() for v in g) == list(range(x))
    assert [len(given[g]) for g in sorted(given)] == [10, 25, 18, 2]
    assert sorted((r.group, r.rows) for r in pool.groups().collect()) == [(0, 10), (1, 25), (2, 18), (3, 2)]
    clock_[0] += 1000
    pool.add(spark.createDataFrame([(900,)], "x int"), 10)
    clock_[0] += 1000
    pool.add(spark.createDataFrame([], "x int"), 11)  # nothing has come for long
    assert given[4] == [900]


def test_registry_shows_whole_versions_only(spark, tmp_path):
    registry = keyed.Registry(spark, str(tmp_path / "r"))
    assert registry.latest() is None and registry.best("loss") is None
    put = lambda n: lambda path: spark.range(n).write.parquet(f"{path}/a")

    def fails(path):
        spark.range(9).write.parquet(f"{path}/a")
        raise RuntimeError("half written")

    assert registry.publish(put(1), {"loss": 0.5}) == 1
    with pytest.raises(RuntimeError):
        registry.publish(fails, {"loss": 0.1})
    assert spark.read.parquet(f"{registry.latest()}/a").count() == 1
    registry.publish(put(2), {"loss": 0.25})
    registry.publish(put(3), {"loss": float("nan")})
    registry.publish(put(4))
    assert spark.read.parquet(f"{registry.best('loss')}/a").count() == 2
    assert spark.read.parquet(f"{registry.latest()}/a").count() == 4


# ---- timetables that change -----------------------------------------------------------------------------------------


def snapshot(spark, trips, valid_from):
    return trips_frame(spark, trips).withColumn("valid_from", F.lit(valid_from).cast("bigint"))


def test_equal_snapshots_are_one_version(spark):
    a, a2 = make_trip("a", ["10:00:00"] * 3), make_trip("a", ["11:00:00"] * 3)
    b, c = make_trip("b", []), make_trip("c", ["10:00:00"] * 3)
    days = [(0, [a, b, c]), (10, [a, b]), (20, [a2, b, c]), (30, [a, b, c, c])]
    frames = [snapshot(spark, t, d) for d, t in days]
    folded = versions.fold_versions(frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3]))
    got = sorted((r.trip_id, r.valid_from, r.valid_to) for r in folded.collect())
    assert got == [("a", 0, 20), ("a", 20, 30), ("a", 30, None), ("b", 0, None), ("c", 0, 10), ("c", 20, None)]
    events = positions_frame(spark, [(k, "v", 59.0, 18.0, t, ts) for k, (t, ts) in enumerate([("a", -1), ("a", 0), ("a", 19), ("a", 20), ("c", 10), ("c", 99), ("x", 5), (None, 5), ("b", 50)])])
    got = {r.seq: r.trip_id for r in versions.in_force(events, folded).collect()}
    assert got == {0: "a", 1: "a@0", 2: "a@0", 3: "a@20", 4: "c", 5: "c@20", 6: "x", 7: None, 8: "b@0"}
    assert [r.t for r in spark.createDataFrame([("a@20",), ("a@-5",), ("x",), ("a@b",), ("q@1@2",)], "t string").select(versions.plain_trip(F.col("t")).alias("t")).collect()] == ["a", "a", "x", "a@b", "q@1"]


def test_a_timetable_published_meanwhile_takes_effect_with_the_next_batch(spark, tmp_path):
    day = 1_700_000_000
    early, late = make_trip("A", ["10:00:00"] * 4, [0, 1, 2, 3]), make_trip("A", ["10:00:00"] * 4, [3, 2, 1, 0])
    table = engine.VersionedTimetable(spark, str(tmp_path / "table"), lambda t: features.encode_trips(t, *words(spark), LAYOUT))
    with pytest.raises(ValueError):
        table.get()
    table.publish(trips_frame(spark, [early]), 0)
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows = [at(k, "v", "A", k % 4, day + 10 * k) for k in range(8)]
    job = engine.Engine(table, out, ("arrivals", "messages", "gates", "archive"), LAYOUT)
    land(spark, landing, rows, 0, 4)
    jobs.run_to_end(job.start(positions_stream(spark, landing), log, True))
    table.publish(trips_frame(spark, [late]), day + 40)
    land(spark, landing, rows, 4, 8)
    jobs.run_to_end(job.start(positions_stream(spark, landing), log, True))
    got = sorted((r.seq, r.run, r.trip_id, r.hit) for r in spark.read.parquet(f"{out}/arrivals").collect())
    assert got == [(k, 0, "A@0", k) for k in range(4)] + [(4 + k, 1, f"A@{day + 40}", 3 - k) for k in range(4)]
    assert {r.trip_id for r in spark.read.parquet(f"{out}/archive").collect()} == {"A"}
    batch = versions.in_force(positions_frame(spark, rows), table.get()[0])
    whole = runs.first_arrivals(runs.detect_hits(batch, table.get()[1])).collect()
    assert sorted((r.seq, r.run, r.trip_id, r.hit) for r in whole) == got


def test_streamed_arrivals_make_nothing_that_they_do_not_need(spark):
    """The query of the arrivals staged trip codes and had messages and gates written, which it does not read."""
    from punctual.plans import fixtures as fx

    stage = fx.Stage(spark, "/root/testdata/sf0.001")
    columns = ["id", "run", "trip_id", "n_stops", "hit", "seq", "timestamp"]
    alone = spark.read.parquet(f"{stage.streamed_arrivals}/arrivals").select(*columns)
    assert not {"trip_codes", "layout", "streamed"} & set(stage.__dict__)
    want = stage.arrivals.select(*columns)
    assert sorted(alone.collect()) == sorted(want.collect()) and alone.count() > 20
    other = fx.Stage(spark, "/root/testdata/sf0.001")
    assert other.streamed == other.streamed_arrivals  # a pass that makes all is not repeated
