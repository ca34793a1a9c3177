"""Trip sequences for training and inference, and the training frames made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schedule as sch
from ..functions.vocabulary import EOS, PAD, SOS, ZERO_DELTA, Layout, delta_token
from ..schemas import SEQUENCE_LENGTH, feature_column
from .runs import METRO, MIN_STOPS, reached_by_run


def _coded(trips_nested: DataFrame, routes: DataFrame, stops: DataFrame, route_type: int) -> DataFrame:
    """Trips of one type with route and stop positions in the vocabulary; null where a name is unknown."""
    trips = trips_nested.filter((F.col("route_type") == route_type) & F.col("stops").isNotNull()).select(
        "trip_id",
        "route_id",
        "direction_id",
        F.col("stops.stop_name").alias("names"),
        sch.day_seconds(F.col("stops.arrival_time")).alias("seconds"),
    )
    named = (
        trips.select("trip_id", F.posexplode("names").alias("pos", "stop_name"))
        .join(stops, "stop_name", "left")
        .groupBy("trip_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "stop_ix"))).alias("named"))
    )
    return trips.drop("names").join(routes, "route_id", "left").join(named, "trip_id")


def encode_trips(
    trips_nested: DataFrame, routes: DataFrame, stops: DataFrame, layout: Layout, route_type: int = METRO
) -> DataFrame:
    """Static part of every sequence, once per trip: tokens, seconds per stop, rollover.

    Trips with an unknown route or stop (see ``vocabulary_gaps``) and trips with arrivals at or after hour 24
    are marked by a false ``usable``; the gate and the change detection still count them.
    """
    coded = _coded(trips_nested, routes, stops, route_type)
    routed = F.col("route_ix").isNotNull() & F.col("direction_id").isNotNull()
    known = routed & F.forall("named", lambda x: x["stop_ix"].isNotNull())
    return coded.select(
        "trip_id",
        (known & sch.is_plain_day(F.col("seconds"))).alias("usable"),
        (layout.route0 + layout.routes * F.col("direction_id") + F.col("route_ix")).cast("int").alias("route_token"),
        F.transform("named", lambda x: (x["stop_ix"] + layout.stop0).cast("int")).alias("stop_tokens"),
        "seconds",
    ).withColumn("rollover", sch.rollover_index(F.col("seconds")))


def vocabulary_gaps(trips_nested: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Route ids and stop names in use that the vocabulary lacks, with the number of trips or calls concerned."""
    used_routes = trips_nested.groupBy(F.col("route_id").alias("name")).agg(F.count("*").alias("uses"))
    used_stops = (
        trips_nested.select(F.explode("stops.stop_name").alias("name"))
        .groupBy("name")
        .agg(F.count("*").alias("uses"))
    )
    lacking_routes = used_routes.join(routes, F.col("name") == F.col("route_id"), "left_anti")
    lacking_stops = used_stops.join(stops, F.col("name") == F.col("stop_name"), "left_anti")
    return lacking_routes.select(F.lit("route").alias("kind"), "name", "uses").unionByName(
        lacking_stops.select(F.lit("stop").alias("kind"), "name", "uses")
    )


# ---- pieces of a sequence -------------------------------------------------------------------------------------------


def delays(times: Column, scheduled: Column) -> Column:
    """Real minus scheduled seconds per stop, null where the real time is unknown."""
    return F.zip_with(times, scheduled, lambda real, plan: real - plan)


def delay_steps(delay: Column) -> Column:
    """Change of delay against the last known delay (0 before the first); 0 for unknown stops. One pass over the array."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.array().cast("array<bigint>").alias("steps"), zero.alias("last"))

    def step(done: Column, x: Column) -> Column:
        change = F.coalesce(x - done["last"], zero)
        return F.struct(F.concat(done["steps"], F.array(change)).alias("steps"), F.coalesce(x, done["last"]).alias("last"))

    return F.aggregate(delay, start, step, lambda done: done["steps"])


def _pairs(stop_tokens: Column, delta_tokens: Column) -> Column:
    """Stop and delta tokens interleaved."""
    return F.flatten(F.zip_with(stop_tokens, delta_tokens, lambda s, d: F.array(s, d)))


def _pad(tokens: Column) -> Column:
    missing = F.greatest(F.lit(SEQUENCE_LENGTH) - F.size(tokens), F.lit(0))
    return F.concat(tokens, F.array_repeat(F.lit(PAD), missing))


def tokens_text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda x: x.cast("string")), ",")


def _with_schedule(df: DataFrame, layout: Layout, offset_s: int, zone: str | None) -> DataFrame:
    day = sch.event_day(F.col("timestamp"))
    rollover = F.col("rollover")
    seconds = F.col("seconds")
    plan = (
        sch.resolve(seconds, day, rollover, offset_s)
        if zone is None
        else sch.resolve_in_zone(seconds, day, rollover, zone)
    )
    first_day = F.date_from_unix_date(day - F.when(rollover > 0, 1).otherwise(0))
    return (
        df.withColumn("scheduled", plan)
        .withColumn("weekday_token", layout.weekday0 + F.weekday(first_day))
        .withColumn("hour_token", (layout.hour0 + F.floor(F.get(seconds, F.lit(0)) / 3600)).cast("int"))
    )


def _delta_tokens(known: Column, alignment: str) -> Column:
    """Delta token after every stop. 'lagged': the first is zero and the one after stop i is the change at
    stop i-1; 'aligned': the one after stop i is the change at stop i."""
    tokens = F.transform(delay_steps(known), delta_token)
    if alignment == "aligned":
        return tokens
    if alignment != "lagged":
        raise ValueError(f"unknown alignment {alignment!r}")
    return F.concat(F.array(F.lit(ZERO_DELTA)), F.slice(tokens, F.lit(1), F.size(tokens) - 1))


def _head() -> Column:
    return F.array(F.lit(SOS), F.col("route_token"), F.col("weekday_token"), F.col("hour_token"))


# ---- training -------------------------------------------------------------------------------------------------------


def training_gate(reached: DataFrame) -> DataFrame:
    """Runs that reached their last stop with at most half of the stops missing, as of the first event at which
    that held (``seq``, ``timestamp``), with the times known then.

    Both conditions only become true at arrivals and stay true, so the gate follows from the arrivals alone.
    """
    n = F.col("n_stops")
    visits = F.array_sort(F.transform(F.array_compact("reached"), lambda r: r["seq"]))
    needed = n - F.floor(n / 2).cast("int")
    enough = F.get(F.col("visits"), F.col("needed") - 1)
    last = F.get("reached", n - 1)["seq"]
    opened = F.filter("reached", lambda r: r["seq"] == F.col("gate"))
    return (
        reached.filter(n >= MIN_STOPS)
        .withColumn("visits", visits)
        .withColumn("needed", needed)
        .withColumn("gate", F.when(enough.isNotNull() & last.isNotNull(), F.greatest(enough, last)))
        .filter(F.col("gate").isNotNull())
        .select(
            "id",
            "run",
            "trip_id",
            "n_stops",
            F.col("gate").alias("seq"),
            F.get(opened, F.lit(0))["timestamp"].alias("timestamp"),
            F.transform("reached", lambda r: F.when(r["seq"] <= F.col("gate"), r["timestamp"])).alias("times"),
        )
    )


def once_per_trip(gated: DataFrame) -> DataFrame:
    """The earliest gate of every trip_id over all vehicles and runs; combined before the shuffle."""
    rest = [c for c in gated.columns if c != "trip_id"]
    return (
        gated.groupBy("trip_id")
        .agg(F.min_by(F.struct(*rest), F.col("seq")).alias("row"))
        .select("trip_id", *[F.col(f"row.{c}").alias(c) for c in rest])
    )


def training_tokens(
    gated: DataFrame,
    trip_codes: DataFrame,
    layout: Layout,
    alignment: str = "lagged",
    offset_s: int = sch.LOCAL_TO_UTC_S,
    zone: str | None = None,
) -> DataFrame:
    """``(trip_id, id, seq, timestamp, tokens)``: start, route, weekday, hour, (stop, delta)*, end, padding."""
    ready = _with_schedule(gated.join(trip_codes.filter("usable"), "trip_id"), layout, offset_s, zone)
    body = _pairs(F.col("stop_tokens"), _delta_tokens(delays(F.col("times"), F.col("scheduled")), alignment))
    return ready.select(
        "trip_id", "id", "seq", "timestamp", _pad(F.concat(_head(), body, F.array(F.lit(EOS)))).alias("tokens")
    )


def training_delays(gated: DataFrame, trip_codes: DataFrame, offset_s: int = sch.LOCAL_TO_UTC_S) -> DataFrame:
    """Per stop of the gated runs: the delay, its change against the last known delay, and the token of that."""
    ready = gated.join(trip_codes.filter("usable"), "trip_id")
    plan = sch.resolve(F.col("seconds"), sch.event_day(F.col("timestamp")), F.col("rollover"), offset_s)
    known = ready.withColumn("late", delays(F.col("times"), plan))
    steps = F.arrays_zip(F.col("late"), delay_steps(F.col("late")).alias("step"))
    return known.select("trip_id", "id", "run", F.posexplode(steps).alias("stop_index", "x")).select(
        "trip_id",
        "id",
        "run",
        "stop_index",
        F.col("x.late").alias("delay"),
        "x.step",
        delta_token(F.col("x.step")).alias("token"),
    )


def training_sequences(arrivals: DataFrame, trip_codes: DataFrame, layout: Layout, **options) -> DataFrame:
    """Training features end to end: gate, once per trip, plain-day trips, tokens."""
    gated = once_per_trip(training_gate(reached_by_run(arrivals)))
    return training_tokens(gated, trip_codes, layout, **options)


# ---- inference ------------------------------------------------------------------------------------------------------


def inference_tokens(
    emits: DataFrame,
    trip_codes: DataFrame,
    layout: Layout,
    alignment: str = "lagged",
    offset_s: int = sch.LOCAL_TO_UTC_S,
    zone: str | None = None,
) -> DataFrame:
    """``(trip_id, id, seq, timestamp, highest, tokens)`` for events with ``times`` and ``highest``: as for
    training, without end marker, with the skip token in place of deltas that lie ahead."""
    ready = _with_schedule(emits.join(trip_codes.filter("usable"), "trip_id"), layout, offset_s, zone)
    ahead = F.col("highest") + (1 if alignment == "lagged" else 0)
    known = _delta_tokens(delays(F.col("times"), F.col("scheduled")), alignment)
    shown = F.transform(known, lambda x, i: F.when(i <= ahead, x).otherwise(F.lit(layout.skip)))
    return ready.select(
        "trip_id",
        "id",
        "seq",
        "timestamp",
        "highest",
        _pad(F.concat(_head(), _pairs(F.col("stop_tokens"), shown))).alias("tokens"),
    )


def inference_emits(runs: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The events that ask for a new prediction, with the stop times known at each.

    A run has at most one such event per stop and one at its start, so neither side of the join is hot.
    """
    return emits_with_times(runs, reached_by_run(arrivals))


def emits_with_times(runs: DataFrame, reached: DataFrame) -> DataFrame:
    """As ``inference_emits``, from the stops ``reached`` by each run."""
    reached = reached.select("id", "run", "reached")
    empty = F.transform(F.sequence(F.lit(1), F.col("n_stops")), lambda i: F.lit(None).cast("bigint"))
    known = F.transform("reached", lambda r: F.when(r["seq"] <= F.col("seq"), r["timestamp"]))
    return (
        runs.filter(F.col("kind") == "new")
        .select("id", "run", "seq", "timestamp", "trip_id", "n_stops", "highest")
        .join(reached, ["id", "run"], "left")
        .withColumn("times", F.coalesce(known, empty))
        .drop("reached")
    )


def inference_sequences(
    runs: DataFrame, arrivals: DataFrame, trip_codes: DataFrame, layout: Layout, **options
) -> DataFrame:
    """Inference features end to end."""
    return inference_tokens(inference_emits(runs, arrivals), trip_codes, layout, **options)


def inference_messages(runs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Message text per event: ``id:tokens`` for a new sequence, the bare id to repeat the last prediction."""
    fresh = sequences.select("id", "seq", F.concat_ws(":", "id", tokens_text(F.col("tokens"))).alias("message"))
    repeat = runs.filter(F.col("kind") == "resend").select("id", "seq", F.col("id").alias("message"))
    return fresh.unionByName(repeat)


# ---- training frames ------------------------------------------------------------------------------------------------


def width_of(sequences: DataFrame) -> int:
    """Columns that hold every sequence: the usual length, or the longest one if trips need more."""
    return max(SEQUENCE_LENGTH, sequences.agg(F.max(F.size("tokens"))).first()[0] or 0)


def token_columns(width: int) -> list[Column]:
    """One column per token, padded to ``width``. A longer sequence fails the job: none is cut or left out."""
    long = F.concat(F.lit(f"a sequence of more than {width} tokens: "), F.size("tokens").cast("string"))
    fits = F.when(F.size("tokens") > width, F.raise_error(long)).otherwise(F.col("tokens"))
    padded = [F.coalesce(F.get(fits if i == 0 else F.col("tokens"), F.lit(i)), F.lit(PAD)) for i in range(width)]
    return [c.alias(feature_column(i)) for i, c in enumerate(padded)]


def wide_features(sequences: DataFrame, key: bool = True, width: int | None = None) -> DataFrame:
    """One column per token and a random key. ``width`` follows the longest sequence unless it is given."""
    columns = token_columns(width or width_of(sequences))
    return sequences.select(*columns, *([F.expr("uuid()").alias("uuid")] if key else []))


def from_wide(features: DataFrame) -> DataFrame:
    """Token arrays of a wide feature table of any width; the key is dropped at the scan."""
    names = sorted((c for c in features.columns if c.startswith("feature_")), key=lambda c: int(c.split("_")[1]))
    return features.select(F.array(*[F.coalesce(c, F.lit(PAD)) for c in names]).alias("tokens"))


def shifted_pairs(sequences: DataFrame) -> DataFrame:
    """Next-token pairs: ``x`` without the last token, ``y`` without the first."""
    n = F.size("tokens") - 1
    return sequences.withColumn("x", F.slice("tokens", F.lit(1), n)).withColumn(
        "y", F.slice("tokens", F.lit(2), n)
    )


def assign_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Random split by a hash of the key: needs no sort or count and gives the same split on every run."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    point = bucket.cast("bigint") / F.lit(float(1 << 32))
    names = list(shares)
    total = sum(shares.values())
    split, upper = F, 0.0
    for name in names[:-1]:
        upper += shares[name] / total
        split = split.when(F.col("_point") < upper, name)
    return df.withColumn("_point", point).withColumn("split", split.otherwise(names[-1])).drop("_point")


FIRST_TARGET = 7


def prefix_examples(sequences: DataFrame) -> DataFrame:
    """One example per delta from position 7 on: the delta and all that follows masked, label = delta - 15.

    Stops at the first padding in an odd place.
    """
    size = F.size("tokens")
    odd = F.sequence(F.lit(FIRST_TARGET), size - 1, F.lit(2))
    padded = F.array_min(F.filter(odd, lambda j: F.get("tokens", j) == PAD))
    end = F.coalesce(padded, size)  # not inside a lambda: there it is worked out anew for every place
    targets = F.when((size > FIRST_TARGET) & (end > FIRST_TARGET), F.sequence(F.lit(FIRST_TARGET), end - 1, F.lit(2)))
    masked = F.concat(F.slice("tokens", F.lit(1), F.col("place")), F.array_repeat(F.lit(PAD), size - F.col("place")))
    return sequences.withColumn("place", F.explode(targets)).select(
        *[c for c in sequences.columns if c != "tokens"],
        "place",
        masked.alias("tokens"),
        (F.get("tokens", F.col("place")) - ZERO_DELTA).cast("double").alias("label"),
    )
