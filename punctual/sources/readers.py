"""Batch and streaming readers. Every schema is explicit, every path is a folder or glob of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.features import from_wide
from ..operators.timetable import from_pipe_lists, judge_pipe_lists
from ..session import fresh_folder

CORRUPT = "_corrupt_record"


# ---- timetable ------------------------------------------------------------------------------------------------------


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    # A CSV schema goes by position, so the file's own header decides the order of the columns.
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in schema.fields}
    ordered = type(schema)([known[c] if c in known else _text(c) for c in header])
    return spark.read.schema(ordered).option("header", True).option("mode", "FAILFAST").csv(path)


def _text(name: str):
    return T.StructField(name, T.StringType())


def read_timetable(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five timetable files of an unpacked feed."""
    files = {
        "trips": schemas.TRIPS,
        "routes": schemas.ROUTES,
        "agency": schemas.AGENCY,
        "stop_times": schemas.STOP_TIMES,
        "stops": schemas.STOPS,
    }
    return {name: _csv(spark, f"{folder}/{name}.txt", schema) for name, schema in files.items()}


def read_trip_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``trips_nested`` from pipe-list CSV (plain or gzip), and the rows that do not parse."""
    return from_pipe_lists(_csv(spark, path, schemas.TRIP_LISTS))


def judged_trip_lists(spark: SparkSession, path: str) -> DataFrame:
    """Every row of pipe-list CSV with ``parsed`` and ``n_calls``, in one read of the files."""
    return judge_pipe_lists(_csv(spark, path, schemas.TRIP_LISTS))


# ---- position feeds -------------------------------------------------------------------------------------------------


def _feed_schema():
    return T.StructType([*schemas.FEED.fields, T.StructField(CORRUPT, T.StringType())])


def read_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Landed feed messages as JSON, one folder per agency (``agency=...``), undecodable ones kept as text."""
    return (
        spark.read.schema(_feed_schema())
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("basePath", folder)
        .json(f"{folder}/agency=*")
    )


def stream_feeds(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The same folders as an endless stream; ``max_files`` per micro-batch is the rate limit."""
    reader = (
        spark.readStream.schema(_feed_schema())
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("basePath", folder)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(f"{folder}/agency=*")


def quarantined(feeds: DataFrame) -> DataFrame:
    """Payloads that could not be decoded, with the number of entities that were readable in them."""
    readable = F.coalesce(F.size("entity"), F.lit(0))
    return feeds.filter(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("payload"), "agency", F.greatest(readable, F.lit(0)).alias("readable")
    )


def incomplete_entities(feeds: DataFrame) -> DataFrame:
    """Entities of decoded messages that lack a vehicle id, a position or a timestamp, as JSON text."""
    if CORRUPT in feeds.columns:
        feeds = feeds.filter(F.col(CORRUPT).isNull())
    kept = [c for c in ("agency",) if c in feeds.columns]
    v = "e.vehicle"
    lacks = F.col(f"{v}.vehicle.id").isNull() | F.col(f"{v}.position").isNull() | F.col(f"{v}.timestamp").isNull()
    entities = feeds.select(*kept, F.explode("entity").alias("e"))
    return entities.filter(lacks).select(F.to_json("e").alias("payload"), *kept)


def flatten_feed(feeds: DataFrame) -> DataFrame:
    """Position events of the entities that have a vehicle id, a position and a timestamp.

    A trip without an id gives the empty id; no trip at all gives null. ``agency`` is kept where present. A
    message that did not decode is left out as a whole; see ``quarantined``.
    """
    if CORRUPT in feeds.columns:
        feeds = feeds.filter(F.col(CORRUPT).isNull())
    entity = feeds.select(
        *[c for c in ("agency",) if c in feeds.columns], F.explode("entity").alias("e")
    )
    v = "e.vehicle"
    trip_id = F.when(F.col(f"{v}.trip").isNotNull(), F.coalesce(F.col(f"{v}.trip.trip_id"), F.lit("")))
    return entity.filter(
        F.col(f"{v}.vehicle.id").isNotNull() & F.col(f"{v}.position").isNotNull() & F.col(f"{v}.timestamp").isNotNull()
    ).select(
        *[c for c in ("agency",) if c in feeds.columns],
        F.col(f"{v}.vehicle.id").alias("id"),
        F.coalesce(F.col(f"{v}.position.latitude"), F.lit(0.0)).alias("lat"),
        F.coalesce(F.col(f"{v}.position.longitude"), F.lit(0.0)).alias("lng"),
        trip_id.alias("trip_id"),
        F.col(f"{v}.timestamp").alias("timestamp"),
    )


#: Values of ``seq`` in one second: a block of a million values is 17 minutes of a vehicle.
ORDER_TICKS = 1 << 10


def with_order(positions: DataFrame) -> DataFrame:
    """A ``seq`` for events that carry no ingest number: the timestamp, then a place among the vehicle's fixes of that second.

    Feeds repeat a vehicle that has not reported since; such exact repeats are dropped, so ``seq`` is unique for a
    vehicle. More different fixes in one second than ``ORDER_TICKS`` fail the job. A stream can't look back: there
    the place is a hash of the row and repeats stay.
    """
    row = ["id", "lat", "lng", "trip_id"]
    if positions.isStreaming:
        tie = F.pmod(F.xxhash64(*row), F.lit(ORDER_TICKS))
        return positions.withColumn("seq", F.col("timestamp") * ORDER_TICKS + tie)
    place = F.row_number().over(W.partitionBy("id", "timestamp").orderBy("lat", "lng", "trip_id")) - 1
    full = F.raise_error(F.concat(F.lit("too many fixes in one second: "), F.col("id")))
    tie = F.when(F.col("_tie") < ORDER_TICKS, F.col("_tie")).otherwise(full)
    return (
        positions.dropDuplicates([*row, "timestamp"])
        .withColumn("_tie", place)
        .withColumn("seq", F.col("timestamp") * ORDER_TICKS + tie)
        .drop("_tie")
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    first, *rest = feeds
    for other in rest:
        first = first.unionByName(other)
    return first


# ---- archive --------------------------------------------------------------------------------------------------------


FILE_STRIDE = 1 << 32  # more rows than any one archive file holds
FILE_RANGES, FILES_IN_GROUP = 64, 4096


def archive_files(spark: SparkSession, folder: str, start: int = 0) -> DataFrame:
    """Archive files ``(path, uri, file_ix)`` in name order from a start index; contents are not read.

    Names are ranked inside ranges of names; only one row per range meets in a window. The ranges are kept as a table: a
    second listing and range partitioning need not give the same ones.
    """
    ranges = fresh_folder(spark, "archive-files")
    (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv.gz")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", F.col("_metadata.file_path").alias("uri"))
        .repartitionByRange(FILE_RANGES, "uri")
        .withColumn("_range", F.spark_partition_id())
        .write.parquet(ranges)
    )
    named = spark.read.parquet(ranges)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = named.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("uri")) - 1
    ranked = named.withColumn("_inside", inside).join(offsets, "_range")
    return ranked.select("path", "uri", (F.col("_offset") + F.col("_inside")).alias("file_ix")).filter(F.col("file_ix") >= start)


def _archive_rows(spark: SparkSession, folder: str, start: int) -> tuple[DataFrame, DataFrame]:
    """The files from ``start`` on, and their rows with the file's ``uri`` and the place ``row`` in it, from 1.

    A gzip file is never split, so the rows of a file stay together and in order; they are numbered per file, which the
    archive sinks keep small. Of the driver's listing only the name of the first file is fetched; the scan leaves out
    the files before it.
    """
    files = archive_files(spark, folder, start)
    first = files.agg(F.min("uri")).first()[0]
    rows = (
        spark.read.schema(schemas.ARCHIVE)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv.gz")
        .csv(folder)
        .select("*", F.col("_metadata.file_path").alias("uri"))
        .filter(F.col("_metadata.file_path") >= F.lit(first))
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return files, rows.withColumn("row", F.row_number().over(W.partitionBy("uri").orderBy("_at"))).drop("_at")


def replay_archive(spark: SparkSession, folder: str, start: int = 0) -> DataFrame:
    """Archived events of the files from ``start`` on, in name order; a bad row fails the read.

    ``seq`` follows file order and row order inside a file.
    """
    files, rows = _archive_rows(spark, folder, start)
    seq = F.col("file_ix") * FILE_STRIDE + F.col("row")
    return rows.join(files.select("uri", "file_ix"), "uri").select(seq.alias("seq"), "id", "lat", "lng", "trip_id", "timestamp")


def replay_in_order(spark: SparkSession, folder: str, start: int = 0) -> DataFrame:
    """As ``replay_archive``, with ``seq`` counting the replayed events from 1 without gaps.

    Files take the rows before them from sums over groups of files, then over the files of a group.
    """
    files, rows = _archive_rows(spark, folder, start)
    sizes = rows.groupBy("uri").agg(F.count(F.lit(1)).alias("size")).join(files.select("uri", "file_ix"), "uri")
    sizes = sizes.withColumn("group", F.floor(F.col("file_ix") / FILES_IN_GROUP))
    groups = sizes.groupBy("group").agg(F.sum("size").alias("held"))

    def earlier(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    groups = groups.select("group", earlier("held", W.orderBy("group")).alias("before"))
    within = earlier("size", W.partitionBy("group").orderBy("file_ix"))
    offsets = sizes.withColumn("inside", within).join(groups, "group").select("uri", (F.col("before") + F.col("inside")).alias("offset"))
    seq = F.col("offset") + F.col("row")
    return rows.join(offsets, "uri").select(seq.alias("seq"), "id", "lat", "lng", "trip_id", "timestamp")


def stream_archive(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """The archive as a rate-limited stream, for a replay through the live steps."""
    return with_order(
        spark.readStream.schema(schemas.ARCHIVE)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv.gz")
        .option("maxFilesPerTrigger", max_files)
        .csv(folder)
        .select("id", "lat", "lng", "trip_id", "timestamp")
    )


# ---- features and messages ------------------------------------------------------------------------------------------


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Stored wide training features as token arrays."""
    return from_wide(spark.read.option("mergeSchema", True).parquet(path))


def read_token_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of tokens, one sequence per line, of any length; a value that is no integer fails the read."""
    bad = F.raise_error(F.concat(F.lit("not a line of tokens: "), F.left("value", F.lit(200))))
    token = lambda x: F.coalesce(x.try_cast("int"), bad)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.transform(F.split("value", ","), token).alias("tokens"))


def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    """New feature messages of a landing table."""
    return spark.readStream.schema("id string, seq bigint, message string").parquet(folder)


def parse_positions(messages: DataFrame) -> DataFrame:
    """Position events from JSON text in ``value``; malformed or incomplete messages are skipped."""
    parsed = F.from_json("value", "id string, lat double, lng double, trip_id string, timestamp bigint, "
                                  "route_type bigint")
    rows = messages.withColumn("_p", parsed).select(*[c for c in messages.columns if c != "value"], "_p.*")
    return rows.dropna(subset=["id", "lat", "lng", "timestamp"])
