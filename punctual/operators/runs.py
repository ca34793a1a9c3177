"""Trip runs, stop detection and running state of every vehicle.

All of this depends on the order of a vehicle's events. One vehicle may hold a large part of the data, so no
window spans a whole vehicle: windows run inside (vehicle, block), where a block is a fixed range of ``seq``
and thus holds at most ``block_rows`` events. One summary row per (vehicle, block) carries the state from
block to block. ``seq`` must be unique; that is what bounds a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import chord_terms, term_to_metres, unit_vector

METRO = 401
STOP_RADIUS_M = 250.0
SEARCH_CAP_M = 1000.0
MIN_STOPS = 3
BLOCK_ROWS = 1 << 20

# A running maximum over (run number, value) packed in one long restarts by itself at every new run. The value is a
# stop index, which an array keeps below 2^31; that leaves 2^31 runs for one vehicle.
_BITS = 32
_SLOT = 1 << _BITS


def block_of(seq: Column, block_rows: int) -> Column:
    return F.call_function("div", seq, F.lit(block_rows))


def enrich(positions: DataFrame, trips_nested: DataFrame, drop_stops: bool = False) -> DataFrame:
    """Attach trip metadata: events without trip are dropped, events of an unknown trip keep null metadata."""
    meta = trips_nested.drop("stops") if drop_stops else trips_nested
    return positions.filter(F.col("trip_id").isNotNull()).join(meta, "trip_id", "left")


def detect_hits(
    positions: DataFrame,
    trips_nested: DataFrame,
    route_type: int = METRO,
    radius_m: float = STOP_RADIUS_M,
    cap_m: float = SEARCH_CAP_M,
) -> DataFrame:
    """Narrow events ``(id, seq, timestamp, trip_id, n_stops, hit)`` of trips of one route type.

    ``hit`` is the index of the trip's closest stop if that lies within the radius. The wide stop list is
    dropped in the join stage, before anything is shuffled by vehicle.
    """
    # Single fields of the stops keep the other fields out of the scan; their vectors are made once per trip.
    sites = trips_nested.filter((F.col("route_type") == route_type) & F.col("stops").isNotNull()).select(
        "trip_id",
        F.size("stops.stop_lat").alias("n_stops"),
        F.transform(
            F.arrays_zip("stops.stop_lat", "stops.stop_lon"),
            lambda s: F.struct(*unit_vector(s["stop_lat"], s["stop_lon"])),
        ).alias("sites"),
    )
    nearest = term_to_metres(F.col("nearest"))
    return (
        positions.filter(F.col("trip_id").isNotNull())
        .select("id", "seq", "timestamp", "trip_id", *unit_vector(F.col("lat"), F.col("lng")))
        .join(sites, "trip_id")
        .withColumn("terms", chord_terms(F.col("sites"), F.col("ux"), F.col("uy"), F.col("uz")))
        .withColumn("nearest", F.array_min("terms"))
        .select(
            "id",
            "seq",
            "timestamp",
            "trip_id",
            "n_stops",
            # The first of equally near stops is taken.
            F.when((nearest < radius_m) & (nearest < cap_m), F.array_position("terms", F.col("nearest")) - 1)
            .cast("int")
            .alias("hit"),
        )
    )


def _numbered(hits: DataFrame, block_rows: int) -> DataFrame:
    """Events with their block and the run counted from 0 inside the block."""
    w = W.partitionBy("id", "block").orderBy("seq", "timestamp")
    changed = F.coalesce(F.col("trip_id") != F.lag("trip_id").over(w), F.lit(False))
    return (
        hits.withColumn("block", block_of(F.col("seq"), block_rows))
        .filter(F.col("id").isNotNull() & F.col("block").isNotNull())
        .withColumn("changed", changed.cast("bigint"))
        .withColumn("local_run", F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .drop("changed")
    )


def _local(hits: DataFrame, block_rows: int) -> DataFrame:
    """Numbered events with the highest stop of the run so far, packed as ``mark``."""
    w = W.partitionBy("id", "block").orderBy("seq", "timestamp")
    packed = F.col("local_run") * _SLOT + F.coalesce(F.col("hit") + 1, F.lit(0))
    judged = F.when(F.col("n_stops") >= MIN_STOPS, F.col("mark"))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return (
        _numbered(hits, block_rows)
        .withColumn("mark", F.max(packed).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("before", F.last(judged, ignorenulls=True).over(before))
    )


def _run_of(mark: Column) -> Column:
    return F.shiftright(mark, _BITS)


def _top_of(mark: Column) -> Column:
    """Highest stop index in a packed mark, -1 for none."""
    return mark.bitwiseAND(_SLOT - 1) - 1


def _carries(local: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """State at the start of every (vehicle, block), from one summary row per block.

    The summary uses the same columns as the events themselves, so both sides of the join read one exchange. A
    ``state`` of earlier events counts as a block before the first.
    """
    w = W.partitionBy("id").orderBy("block")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    order, trip = F.struct("seq", "timestamp"), F.struct("trip_id", "n_stops")
    summary = local.groupBy("id", "block").agg(
        F.min_by(trip, order).alias("first_trip"),
        F.max_by(trip, order).alias("last_trip"),
        F.max("mark").alias("tail"),
        F.max(F.when(F.col("n_stops") >= MIN_STOPS, F.col("mark"))).alias("judged"),
    )
    if state is not None:
        judged = F.col("judged_run") * _SLOT + F.col("judged") + 1
        summary = summary.unionByName(
            state.select(
                "id",
                F.lit(None).cast("bigint").alias("block"),
                trip.alias("first_trip"),
                trip.alias("last_trip"),
                (F.col("run") * _SLOT + top_reached(F.col("reached")) + 1).alias("tail"),
                judged.alias("judged"),
            )
        )
    boundary = F.coalesce(F.col("first_trip") != F.lag("last_trip").over(w), F.lit(False)).cast("bigint")
    inner = _run_of(F.col("tail"))
    return (
        summary.withColumn("boundary", boundary)
        .withColumn("run_end", F.sum(F.col("boundary") + inner).over(so_far))
        .withColumn("base_run", F.col("run_end") - inner)
        .withColumn("run_top", F.max(F.col("run_end") * _SLOT + _top_of(F.col("tail")) + 1).over(so_far))
        .withColumn("prior", F.lag("run_top").over(w))
        .withColumn("carry_top", F.when(_run_of(F.col("prior")) == F.col("base_run"), _top_of(F.col("prior"))))
        .withColumn("last_state", _state(F.col("judged"), F.col("base_run"), F.col("carry_top")))
        .withColumn("carry_state", F.last("last_state", ignorenulls=True).over(before))
        .select("id", "block", "base_run", "carry_top", "carry_state")
    )


def _state(mark: Column, base_run: Column, carry_top: Column) -> Column:
    """(run, highest stop) as one packed long from a block-local mark; null if the mark is null."""
    carried = F.when(_run_of(mark) == 0, carry_top)
    highest = F.greatest(_top_of(mark), F.coalesce(carried, F.lit(-1)), F.lit(0))
    return (base_run + _run_of(mark)) * _SLOT + highest


def track_runs(
    hits: DataFrame, block_rows: int = BLOCK_ROWS, reset_on_trip: bool = False, state: DataFrame | None = None
) -> DataFrame:
    """Every event with its ``run``, the ``highest`` stop index reached in the run so far (0 if none), and
    ``kind``: 'new' if the highest index differs from the one at the vehicle's previous event (of trips with at
    least three stops), else 'resend'; null for shorter trips.

    The previous index crosses runs unless ``reset_on_trip``. With ``state`` (see ``next_state``) the events go on
    from those that led to it.
    """
    local = _local(hits, block_rows)
    rows = local.join(_carries(local, state), ["id", "block"])
    now = _state(F.col("mark"), F.col("base_run"), F.col("carry_top"))
    then = F.coalesce(_state(F.col("before"), F.col("base_run"), F.col("carry_top")), F.col("carry_state"))
    if reset_on_trip:
        same = F.col("_now").eqNullSafe(F.col("_then"))
    else:
        same = _top_of(F.col("_now")).eqNullSafe(_top_of(F.col("_then")))
    return (
        rows.withColumn("_now", now)
        .withColumn("_then", then)
        .select(
            "id",
            "seq",
            "timestamp",
            "trip_id",
            "n_stops",
            "hit",
            "block",
            _run_of(F.col("_now")).alias("run"),
            (_top_of(F.col("_now")) + 1).cast("int").alias("highest"),
            F.when(F.col("n_stops") >= MIN_STOPS, F.when(same, "resend").otherwise("new")).alias("kind"),
        )
    )


def number_runs(hits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every event with its run number per vehicle: a run ends when the trip changes (A, B, A gives 0, 1, 2).

    Needs no stops, so none are measured: the distances are pruned from the plan.
    """
    bare = hits.select(
        "id", "seq", "timestamp", "trip_id", F.lit(0).alias("n_stops"), F.lit(None).cast("int").alias("hit")
    )
    return track_runs(bare, block_rows).select("id", "seq", "timestamp", "trip_id", "run")


def first_arrivals(hits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """First time within the radius per (vehicle, run, stop), straight from the narrow events.

    The events are shuffled once and folded to segments, one row per (block, run, stop), right after the run
    count. Everything else works on the segments: one more exchange of them serves both the blocks' first run
    numbers and the rows that get these numbers, so the windows over the events run once.
    """
    arrived = F.when(F.col("hit").isNotNull(), F.col("seq"))
    segments = (
        _numbered(hits, block_rows)
        .groupBy("id", "block", "local_run", "trip_id", "n_stops", "hit")
        .agg(F.min(arrived).alias("seq"), F.min_by("timestamp", arrived).alias("timestamp"))
        .repartition("block", "id")  # in the order of the windows' own exchange it would be dropped
    )
    w = W.partitionBy("id").orderBy("block")
    # Ordered by run; the further columns do not change the order but keep both uses of the segments alike.
    order = F.struct("local_run", "seq", "timestamp", "n_stops", "hit")
    switched = F.coalesce(F.col("first_trip") != F.lag("last_trip").over(w), F.lit(False)).cast("bigint")
    bases = (
        segments.groupBy("id", "block")
        .agg(
            F.min_by("trip_id", order).alias("first_trip"),
            F.max_by("trip_id", order).alias("last_trip"),
            F.max("local_run").alias("inner"),
        )
        .withColumn("steps", F.col("inner") + switched)
        .withColumn("end", F.sum("steps").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .select("id", "block", (F.col("end") - F.col("inner")).alias("base_run"))
    )
    return (
        segments.join(bases, ["id", "block"])
        .groupBy("id", (F.col("base_run") + F.col("local_run")).alias("run"), "trip_id", "n_stops", "hit")
        .agg(F.min("seq").alias("seq"), F.min_by("timestamp", "seq").alias("timestamp"))
        .filter(F.col("seq").isNotNull())
    )


def reached_by_run(arrivals: DataFrame) -> DataFrame:
    """One row per run with ``reached``: array of (seq, timestamp) by stop index, null where not reached.

    At most one arrival per stop of the trip exists, so the list is bounded by the trip's length.
    """
    visits = F.map_from_entries(
        F.collect_list(F.struct("hit", F.struct("seq", "timestamp").alias("visit")))
    )
    return (
        arrivals.groupBy("id", "run", "trip_id", "n_stops")
        .agg(visits.alias("visits"))
        .select(
            "id",
            "run",
            "trip_id",
            "n_stops",
            F.transform(
                F.sequence(F.lit(0), F.col("n_stops") - 1), lambda i: F.try_element_at("visits", i)
            ).alias("reached"),
        )
    )


# ---- batch by batch -------------------------------------------------------------------------------------------------

#: What is known of a vehicle between two batches: its trip and run, when each stop of the run was first reached, and
#: the highest stop and run of its last event on a trip that is judged.
STATE_SCHEMA = (
    "id string, trip_id string, n_stops int, run bigint, reached array<struct<seq:bigint,timestamp:bigint>>, "
    "judged bigint, judged_run bigint"
)


def top_reached(reached: Column) -> Column:
    """Highest index of a list that is not null, -1 for none."""
    places = F.transform(reached, lambda r, i: F.when(r.isNotNull(), i.cast("bigint")))
    return F.coalesce(F.array_max(places), F.lit(-1).cast("bigint"))


def arrivals_of(tracked: DataFrame) -> DataFrame:
    """First arrivals per (vehicle, run, stop) among tracked events, as ``first_arrivals`` gives them."""
    return (
        tracked.filter(F.col("hit").isNotNull())
        .groupBy("id", "run", "trip_id", "n_stops", "hit")
        .agg(F.min("seq").alias("seq"), F.min_by("timestamp", "seq").alias("timestamp"))
    )


def reached_so_far(tracked: DataFrame, state: DataFrame) -> DataFrame:
    """Per run of this batch what it had ``reached`` in the batches before (``known``) and by now (``reached``).

    One row per run, folded from the arrivals: a stop that was known keeps its first time.
    """
    places = F.sequence(F.lit(0), F.col("n_stops") - 1)
    fresh = F.map_from_entries(
        F.filter(
            F.collect_list(F.when(F.col("hit").isNotNull(), F.struct("hit", F.struct("seq", "timestamp").alias("visit")))),
            lambda x: x.isNotNull(),
        )
    )
    first = (
        tracked.groupBy("id", "run", "trip_id", "n_stops", "hit")
        .agg(F.min("seq").alias("seq"), F.min_by("timestamp", "seq").alias("timestamp"))
        .groupBy("id", "run", "trip_id", "n_stops")
        .agg(fresh.alias("fresh"))
    )
    known = state.select("id", "run", F.col("reached").alias("known"))
    now = F.transform(places, lambda i: F.coalesce(F.get("known", i), F.try_element_at("fresh", i)))
    none = F.transform(places, lambda i: F.lit(None).cast("struct<seq:bigint,timestamp:bigint>"))
    return (
        first.join(known, ["id", "run"], "left")
        .withColumn("known", F.coalesce("known", none))
        .withColumn("reached", now)
        .drop("fresh")
    )


def new_arrivals(reached: DataFrame) -> DataFrame:
    """The arrivals that this batch adds, as ``first_arrivals`` gives them."""
    places = F.sequence(F.lit(0), F.col("n_stops") - 1)
    fresh = F.filter(
        F.transform(places, lambda i: F.when(F.get("known", i).isNull(), F.struct(i.alias("hit"), F.get("reached", i).alias("v")))),
        lambda x: x["v"].isNotNull(),
    )
    rows = reached.select("id", "run", "trip_id", "n_stops", F.explode(fresh).alias("x"))
    return rows.select("id", "run", "trip_id", "n_stops", "x.hit", "x.v.seq", "x.v.timestamp")


def next_state(tracked: DataFrame, reached: DataFrame, state: DataFrame) -> DataFrame:
    """The state of the vehicles of this batch after it: one row each, by pre-combined aggregates."""
    order = F.struct("seq", "timestamp")
    judged = F.when(F.col("kind").isNotNull(), order)
    last = tracked.groupBy("id").agg(
        F.max_by(F.struct("trip_id", "n_stops", "run"), order).alias("last"),
        F.max_by(F.struct("highest", "run"), judged).alias("judged_at"),
    )
    before = state.select("id", F.col("judged").alias("judged_before"), F.col("judged_run").alias("judged_run_before"))
    rows = last.select("id", "last.*", "judged_at").join(reached.select("id", "run", "reached"), ["id", "run"])
    return rows.join(before, "id", "left").select(
        "id",
        "trip_id",
        "n_stops",
        "run",
        "reached",
        F.coalesce(F.col("judged_at.highest").cast("bigint"), "judged_before").alias("judged"),
        F.coalesce("judged_at.run", "judged_run_before").alias("judged_run"),
    )


# ---- snapshots ------------------------------------------------------------------------------------------------------


def times_at(reached: Column, seq: Column) -> Column:
    """Real stop times known when event ``seq`` had been processed."""
    return F.transform(reached, lambda r: F.when(r["seq"] <= seq, r["timestamp"]))


def snapshots(runs: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Every event with ``real_stop_times`` known at that moment.

    The per-run lists are joined on (vehicle, run, block): a run that holds much of the data is spread over
    its blocks, each of a bounded number of events.
    """
    reached = reached_by_run(arrivals).select("id", "run", "reached")
    slots = runs.select("id", "run", "block").distinct()
    spread = slots.join(reached, ["id", "run"])
    empty = F.transform(F.sequence(F.lit(1), F.col("n_stops")), lambda i: F.lit(None).cast("bigint"))
    return (
        runs.join(spread, ["id", "run", "block"], "left")
        .withColumn("real_stop_times", F.coalesce(times_at(F.col("reached"), F.col("seq")), empty))
        .drop("reached", "block")
    )
