"""Streaming jobs: sources joined, tracked and written by ``foreachBatch``.

Each writes plain Parquet or CSV folders. A batch writes to its own ``batch=<id>`` folder with overwrite, so a
batch that is repeated after a failure replaces itself and nothing is doubled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.vocabulary import Layout
from ..operators import decode
from ..operators import features as feat
from ..operators.model import fill_sequences
from ..operators.runs import detect_hits, enrich
from ..operators.serving import latest_row, live_json, resend_predictions
from ..sources import readers
from ..sources.writers import ARCHIVE_ROWS_PER_FILE, archive_rows, write_rolled
from .keyed import Pool
from .steps import gate_open, once_per_trip_and_day, stream_arrivals, track_stream

FEED_INTERVAL = "3 seconds"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
METADATA_MAX_AGE_S = 24 * 3600


class DailyTable:
    """A table that is read again once it is older than a day; used inside ``foreachBatch``."""

    def __init__(self, load: Callable[[], DataFrame], max_age_s: float = METADATA_MAX_AGE_S, clock=time.time):
        self.load, self.max_age_s, self.clock = load, max_age_s, clock
        self.loaded_at: float | None = None
        self.table: DataFrame | None = None

    def get(self) -> DataFrame:
        if self.table is None or self.clock() - self.loaded_at > self.max_age_s:
            self.table, self.loaded_at = self.load(), self.clock()
        return self.table


def _trigger(available_now: bool) -> dict:
    return {"availableNow": True} if available_now else {"processingTime": FEED_INTERVAL}


@contextmanager
def _stream_settings(spark: SparkSession) -> Iterator[None]:
    """Settings that a query takes when it starts.

    Keyed state with several columns needs the RocksDB store. The number of state partitions stays with the
    checkpoint for good; it is set to the cores of the cluster.
    """
    wanted = {STATE_STORE: ROCKSDB, "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def start_parquet(df: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet folder, exactly once."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    with _stream_settings(df.sparkSession):
        return writer.trigger(**_trigger(available_now)).start(folder)


def start_batches(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, mode: str = "append"
) -> StreamingQuery:
    """Hand every micro-batch of a stream to ``write``."""
    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    with _stream_settings(df.sparkSession):
        return writer.trigger(**_trigger(available_now)).start()


def start_publish(
    positions: DataFrame, trips: DailyTable, folder: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Enrich positions and write the live JSON messages and the archive.

    Trip metadata is looked up anew in every batch, so the daily refresh takes effect without a restart.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        enriched = enrich(batch, trips.get(), drop_stops=True)
        live_json(enriched).write.mode("overwrite").text(f"{folder}/live/batch={batch_id}")
        (
            archive_rows(enriched)
            .write.mode("overwrite")
            .option("header", True)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", 1_000_000)
            .csv(f"{folder}/archive/batch={batch_id}")
        )

    return start_batches(positions, write, checkpoint, available_now)


def tracked_stream(positions: DataFrame, trips_nested: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Positions to tracked events: metadata join, stop detection, keyed state."""
    return track_stream(detect_hits(positions, trips_nested), ttl_ms)


def start_arrivals(
    positions: DataFrame, trips_nested: DataFrame, folder: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    return start_parquet(stream_arrivals(tracked_stream(positions, trips_nested)), folder, checkpoint, available_now)


def start_messages(
    positions: DataFrame,
    trips_nested: DataFrame,
    trip_codes: DataFrame,
    layout: Layout,
    folder: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Inference messages, new sequences and repeat marks, to ``folder``/messages.

    A batch's tracked events are read twice, so they are kept for the length of the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            emits = kept.filter("kind = 'new'").withColumnRenamed("real_stop_times", "times")
            sequences = feat.inference_tokens(emits, trip_codes, layout)
            messages = feat.inference_messages(kept, sequences)
            messages.write.mode("overwrite").parquet(f"{folder}/messages/batch={batch_id}")
        finally:
            kept.unpersist()

    return start_batches(tracked_stream(positions, trips_nested), write, checkpoint, available_now)


def start_predictions(
    messages: DataFrame,
    model: list[DataFrame],
    layout: Layout,
    folder: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """The prediction job over a stream of messages ``(id, seq, message)``.

    New sequences are filled and decoded (``folder``/predictions), bare ids repeat the vehicle's last prediction
    (``folder``/resent), and the last prediction per vehicle is carried to the next batch (``folder``/latest).
    """
    spark = messages.sparkSession
    shown = ["id", "seq", "delay", "first_predicted_sequence"]

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(df: DataFrame, name: str) -> DataFrame:
            path = f"{folder}/{name}/batch={batch_id}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        filled = fill_sequences(model, decode.asked_sequences(batch).select("id", "seq", "tokens"), layout)
        decoded = decode.decode_delays(filled, layout.skip, filled="answer").select(*shown)
        known = put(decoded, "predictions")
        if batch_id > 0:
            known = known.unionByName(spark.read.parquet(f"{folder}/latest/batch={batch_id - 1}").select(*shown))
        put(resend_predictions(decode.repeat_requests(batch), known), "resent")
        put(latest_row(known).select(*shown), "latest")

    return start_batches(messages, write, checkpoint, available_now)


def rolling_archive(
    spark: SparkSession, folder: str, rows_per_file: int = ARCHIVE_ROWS_PER_FILE, idle_s: float = 60.0, clock=time.time
) -> Pool:
    """The archive of enriched positions that rolls by rows and by idle time: ``folder``/closed holds whole groups."""
    schema = T.StructType([T.StructField("seq", T.LongType()), *schemas.ARCHIVE.fields])

    def give(rows: DataFrame, group: int, n: int) -> None:
        write_rolled(rows, f"{folder}/closed", group, n, rows_per_file)

    return Pool(spark, folder, schema, rows_per_file, idle_s, give, clock)


def start_rolling_archive(
    positions: DataFrame, trips: DailyTable, archive: Pool, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Enrich positions and archive them in files of enough rows; ``archive.close_idle`` closes what is left when idle."""

    def write(batch: DataFrame, batch_id: int) -> None:
        known = enrich(batch, trips.get(), drop_stops=True)
        archive.add(known.select("seq", *archive_rows(known).columns), batch_id)

    return start_batches(positions, write, checkpoint, available_now)


FEATURE_GROUP = 10


def feature_groups(spark: SparkSession, folder: str, idle_s: float = 60.0, clock=time.time, least: int = FEATURE_GROUP) -> Pool:
    """Sequences that wait for company: ``folder``/features holds wide rows with keys, in groups of ten or more."""

    def give(rows: DataFrame, group: int, n: int) -> None:
        feat.wide_features(rows).write.mode("overwrite").parquet(f"{folder}/features/group={group}")

    return Pool(spark, folder, "tokens array<int>", least, idle_s, give, clock)


def start_feature_groups(sequences: DataFrame, groups: Pool, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Training sequences to the feature table in groups; ``groups.close_idle`` closes the last one when idle."""
    return start_batches(sequences.select("tokens"), groups.add, checkpoint, available_now)


def start_feed_sinks(feeds: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Feed messages in one read to positions, to a quarantine of what is broken or incomplete, and to counts.

    ``folder``/positions, /broken (messages that do not decode), /incomplete (entities without id, position or time) and
    /counts. Messages and entities are counted where they are read, and a batch fails unless its parts add up to them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(df: DataFrame, name: str) -> int:
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
            return seen.get["n"]

        whole = F.col(readers.CORRUPT).isNull()
        read = Observation()
        counted = batch.observe(
            read,
            F.count(F.lit(1)).alias("messages"),
            F.count(F.when(whole, 1)).alias("decoded"),
            F.coalesce(F.sum(F.when(whole, F.greatest(F.size("entity"), F.lit(0)))), F.lit(0)).alias("entities"),
        )
        kept = counted.persist()
        try:
            positions = put(readers.flatten_feed(kept), "positions")
            broken = put(readers.quarantined(kept), "broken")
            incomplete = put(readers.incomplete_entities(kept), "incomplete")
        finally:
            kept.unpersist()
        n = read.get
        if n["messages"] != n["decoded"] + broken or n["entities"] != positions + incomplete:
            raise ValueError(f"batch {batch_id} does not add up: {n}, {positions}, {broken}, {incomplete}")
        line = [(n["messages"], broken, n["entities"], incomplete, positions)]
        counts = "messages bigint, broken bigint, entities bigint, incomplete bigint, positions bigint"
        batch.sparkSession.createDataFrame(line, counts).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")

    return start_batches(feeds, write, checkpoint, available_now)


def start_feature_table(
    sequences: DataFrame, folder: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Training sequences to the wide feature table, one group of rows with keys per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        feat.wide_features(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return start_batches(sequences, write, checkpoint, available_now)


def start_training(
    positions: DataFrame,
    trips_nested: DataFrame,
    trip_codes: DataFrame,
    layout: Layout,
    folder: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Training sequences: tracked events, gate, once per trip for ever, tokens; to ``folder``/train.

    The trips emitted so far are a table (``folder``/seen) and each batch leaves out those of the batches before
    it. So no watermark is needed, nothing late is lost, and a repeated batch gives the same rows.
    """
    spark = positions.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        first = feat.once_per_trip(batch)
        if batch_id > 0:
            seen = spark.read.parquet(f"{folder}/seen").filter(F.col("batch") < batch_id).select("trip_id")
            first = first.join(seen, "trip_id", "left_anti")
        first.write.mode("overwrite").parquet(f"{folder}/seen/batch={batch_id}")
        new = spark.read.parquet(f"{folder}/seen/batch={batch_id}")
        feat.training_tokens(new, trip_codes, layout).write.mode("overwrite").parquet(
            f"{folder}/train/batch={batch_id}"
        )

    return start_batches(gate_open(tracked_stream(positions, trips_nested)), write, checkpoint, available_now)


def start_training_within(
    positions: DataFrame,
    trips_nested: DataFrame,
    trip_codes: DataFrame,
    layout: Layout,
    folder: str,
    checkpoint: str,
    delay: str = "10 minutes",
    available_now: bool = False,
) -> StreamingQuery:
    """As ``start_training`` with bounded state: once per trip and service day inside a watermark.

    For live data only: events later than the watermark are lost.
    """
    gated = once_per_trip_and_day(gate_open(tracked_stream(positions, trips_nested)), delay)
    return start_parquet(feat.training_tokens(gated, trip_codes, layout), folder, checkpoint, available_now)


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query and raise its error, if any."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
