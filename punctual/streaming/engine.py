"""One pass from positions to all outputs, batch by batch, with the operators of the batch jobs.

Every micro-batch goes through the same chain of steps: the timetable version in force, stop detection, runs. What the
events before have led to is one row per vehicle in a keyed table; it enters the run tracking as the block before the
first. So the windows stay inside (vehicle, block), a vehicle with a large part of a batch is spread over its blocks,
and no Python runs on the executors. Events of one batch are taken in ``seq`` order, batches in theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vocabulary import Layout
from ..operators import features as feat
from ..operators import runs
from ..operators.serving import live_json
from ..operators.versions import fold_versions, in_force, keyed_versions, plain_trip
from ..sources.writers import archive_rows
from .jobs import start_batches
from .keyed import KeyedTable, Registry
from .steps import chain

#: Outputs of the engine, and what each needs beside the positions and the timetable.
OUTPUTS = ("arrivals", "messages", "gates", "live", "archive")


class FixedTimetable:
    """One timetable for all time."""

    versioned = False

    def __init__(self, trips_nested: DataFrame, trip_codes: DataFrame | None = None):
        self.trips, self.codes = trips_nested, trip_codes

    def get(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Versions to look up, the trips under their keys, and the trips' codes."""
        return self.trips, self.trips, self.codes


class VersionedTimetable:
    """Published timetables, read anew in every batch: a snapshot that is published takes effect with the next one.

    ``encode`` makes the trips' codes from trips under their keys; it is only needed for token sequences.
    """

    versioned = True

    def __init__(self, spark: SparkSession, folder: str, encode: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.registry, self.encode = spark, Registry(spark, folder), encode

    def publish(self, trips_nested: DataFrame, valid_from: int) -> None:
        """Add the snapshot that holds from ``valid_from`` on; all versions and codes are folded once, here."""
        new = trips_nested.withColumn("valid_from", F.lit(valid_from).cast("bigint"))
        before = [row["path"] for row in self.registry.pointers().select("path").collect()]

        def write(path: str) -> None:
            new.write.parquet(f"{path}/snapshots")  # those before stay where they are
            snapshots = self.spark.read.parquet(*[f"{p}/snapshots" for p in (*before, path)])
            fold_versions(snapshots).write.parquet(f"{path}/versions")
            if self.encode:
                self.encode(keyed_versions(self.spark.read.parquet(f"{path}/versions"))).write.parquet(f"{path}/codes")

        self.registry.publish(write)

    def get(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        path = self.registry.latest()
        if path is None:
            raise ValueError("no timetable is published")
        versions = self.spark.read.parquet(f"{path}/versions")
        return versions, keyed_versions(versions), self.spark.read.parquet(f"{path}/codes") if self.encode else None


@dataclass
class Engine:
    """The job: ``start`` runs it on a stream of positions and writes ``folder``/<output>/batch=<number>.

    ``outputs``: 'arrivals' (first arrivals as they happen), 'messages' (inference messages, new sequences and
    repeat marks), 'gates' (runs that are complete enough to train on), 'live' (JSON text) and 'archive' (archive rows).
    """

    timetable: FixedTimetable | VersionedTimetable
    folder: str
    outputs: tuple[str, ...] = ("arrivals",)
    layout: Layout | None = None
    block_rows: int = runs.BLOCK_ROWS

    def __post_init__(self):
        unknown = set(self.outputs) - set(OUTPUTS)
        if unknown or not self.outputs:
            raise ValueError(f"outputs are some of {OUTPUTS}")
        if "messages" in self.outputs and self.layout is None:
            raise ValueError("messages need a layout")

    def start(self, positions: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        return start_batches(positions, self.write, checkpoint, available_now)

    def _state(self, spark: SparkSession) -> KeyedTable:
        return KeyedTable(spark, f"{self.folder}/state", "id", runs.STATE_SCHEMA)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions, trips, codes = self.timetable.get()
        table = self._state(spark)
        positions = batch.persist()
        kept = [positions]

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")

        def version(df: DataFrame) -> DataFrame:
            return in_force(df, versions) if self.timetable.versioned else df

        try:
            if {"arrivals", "messages", "gates"} & set(self.outputs):
                hits = keep(chain(positions, version, lambda df: runs.detect_hits(df, trips)))
                here = hits.select("id").distinct()
                state = keep(table.before(batch_id).join(here, "id", "left_semi"))
                tracked = keep(chain(hits, lambda df: runs.track_runs(df, self.block_rows, state=state)))
                reached = keep(runs.reached_so_far(tracked, state))
                if "arrivals" in self.outputs:
                    put(runs.new_arrivals(reached), "arrivals")
                if "messages" in self.outputs:
                    asked = feat.inference_tokens(feat.emits_with_times(tracked, reached), codes, self.layout)
                    put(feat.inference_messages(tracked, asked), "messages")
                if "gates" in self.outputs:
                    put(opened_gates(reached), "gates")
                table.put(batch_id, runs.next_state(tracked, reached, state))
            if {"live", "archive"} & set(self.outputs):
                known = chain(positions, version, lambda df: runs.enrich(df, trips, drop_stops=True))
                known = keep(known.withColumn("trip_id", plain_trip(F.col("trip_id"))) if self.timetable.versioned else known)
                if "live" in self.outputs:
                    live_json(known).write.mode("overwrite").text(f"{self.folder}/live/batch={batch_id}")
                if "archive" in self.outputs:
                    put(known.select("seq", *archive_rows(known).columns), "archive")
        finally:
            for df in kept:
                df.unpersist()


def opened_gates(reached: DataFrame) -> DataFrame:
    """Runs whose training gate has opened in this batch, with the times known then."""
    before = feat.training_gate(reached.drop("reached").withColumnRenamed("known", "reached")).select("id", "run")
    return feat.training_gate(reached).join(before, ["id", "run"], "left_anti")


def first_of_each_trip(gates: DataFrame) -> DataFrame:
    """A stream of gates (output mode 'update'), each trip once for ever: the one of the earliest batch, there the lowest ``seq``.

    The state is one row a trip, the gate it was emitted with and the times of the first and the last batch that brought
    the trip, in RocksDB and without Python. All gates of a batch have the batch's own time, so a trip is new if both times
    are equal, and a batch costs what it brings, however many trips there have been.
    """
    rest = [c for c in gates.columns if c != "trip_id"]
    first = (
        gates.withColumn("_at", F.current_timestamp())
        .groupBy("trip_id")
        .agg(
            F.min_by(F.struct(*rest), F.struct("_at", "seq")).alias("_row"), F.min("_at").alias("_first"), F.max("_at").alias("_last")
        )
        .filter("_first = _last")
    )
    return first.select(*[F.col(c if c == "trip_id" else f"_row.{c}").alias(c) for c in gates.columns])


def start_training_rows(
    spark: SparkSession, gates: str, timetable: FixedTimetable | VersionedTimetable, layout: Layout, folder: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Training sequences from the engine's gates: once per trip for ever, to ``folder``/batch=<number>."""
    schema = "id string, run bigint, trip_id string, n_stops int, seq bigint, timestamp bigint, times array<bigint>"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(gates)

    def write(batch: DataFrame, batch_id: int) -> None:
        codes = timetable.get()[2]
        feat.training_tokens(batch, codes, layout).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return start_batches(first_of_each_trip(stream), write, checkpoint, available_now, "update")
