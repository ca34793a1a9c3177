"""Sinks: tables, archive files and message text."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.features import wide_features
from ..operators.timetable import one_row_per_trip, to_pipe_lists
from ..schemas import ARCHIVE

ARCHIVE_ROWS_PER_FILE = 1_000_000
RANGE_ROWS, MOST_RANGES = 100_000, 2_000  # rows that are ranked in one task, and the most numbers fetched as bounds


def archive_rows(enriched: DataFrame) -> DataFrame:
    """The 12-column archive row; metadata columns are null for unknown trips."""
    return enriched.select(*ARCHIVE.fieldNames())


def write_archive(enriched: DataFrame, folder: str, mode: str = "append") -> None:
    """Gzip CSV by event date, at most a million rows per file, in event order over the files of a date.

    Ranges of (date, seq) are balanced by Spark's sampling, so a busy date is spread over several tasks and a
    quiet one does not leave a file per task.
    """
    day = F.date_from_unix_date(F.floor(F.col("timestamp") / 86_400).cast("int"))
    rows = enriched.withColumn("date", day)
    (
        rows.repartitionByRange("date", "seq")
        .sortWithinPartitions("date", "seq")
        .select(*ARCHIVE.fieldNames(), "date")
        .write.mode(mode)
        .partitionBy("date")
        .option("header", True)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", ARCHIVE_ROWS_PER_FILE)
        .csv(folder)
    )


def write_rolled(rows: DataFrame, folder: str, group: int, n_rows: int, rows_per_file: int = ARCHIVE_ROWS_PER_FILE) -> None:
    """One group of archive rows (with ``seq``) as gzip CSV in ``seq`` order: ``n_rows`` rows in files of ``rows_per_file``.

    What is left over goes to the last file, so none is smaller unless the whole group is. A row's file follows from
    its rank, which is counted inside ranges of ``seq`` and over the ranges; a file is one task's work. The bounds of the
    ranges are fixed first: sizes and ranks must come from the same ranges, which two range partitionings need not give.
    """
    ranged = _in_ranges(rows, n_rows)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.col("_offset") + F.row_number().over(W.partitionBy("_range").orderBy("seq")) - 1
    last = max(1, n_rows // rows_per_file) - 1
    file = F.least(F.floor(rank / rows_per_file), F.lit(last))
    (
        ranged.join(offsets, "_range")
        .withColumn("file", F.format_string("%06d", file))
        .repartition("file")
        .sortWithinPartitions("file", "seq")
        .select(*ARCHIVE.fieldNames(), "file")
        .write.mode("overwrite")
        .partitionBy("file")
        .option("header", True)
        .option("compression", "gzip")
        .csv(f"{folder}/group={group:09d}")
    )


def _in_ranges(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows with ``_range``, of ascending ``seq`` (null first) and about equal size, by bounds that are plain numbers."""
    parts = min(MOST_RANGES, -(-n_rows // RANGE_ROWS))
    bounds = rows.approxQuantile("seq", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    if not bounds:
        return rows.withColumn("_range", F.lit(0.0))
    splits = [-math.inf, *sorted(set(bounds)), math.inf]
    keyed = rows.withColumn("_at", F.coalesce(F.col("seq").cast("double"), F.lit(-math.inf)))
    return Bucketizer(splits=splits, inputCol="_at", outputCol="_range").transform(keyed).drop("_at")


def write_trip_table(trips_nested: DataFrame, folder: str) -> None:
    """The daily trip table as nested Parquet; the form every job reads. A repeated trip is kept once, so that no event is
    doubled by the join with it."""
    one_row_per_trip(trips_nested).write.mode("overwrite").parquet(folder)


def write_trip_lists(trips_nested: DataFrame, folder: str) -> None:
    """The interchange form: gzip CSV with pipe-joined stop lists."""
    to_pipe_lists(trips_nested).write.mode("overwrite").option("header", True).option(
        "compression", "gzip"
    ).csv(folder)


def write_timetable(tables: dict[str, DataFrame], folder: str) -> None:
    """The five timetable files by name, as CSV with a header."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.txt")


def write_token_csv(sequences: DataFrame, folder: str) -> None:
    """Tokens as headerless CSV, one sequence per line; empty sequences have no line."""
    sequences.filter(F.size("tokens") > 0).select(F.array_join("tokens", ",")).write.mode("append").text(folder)


def append_training_features(sequences: DataFrame, folder: str) -> None:
    """Wide feature rows with a random key."""
    wide_features(sequences).write.mode("append").parquet(folder)


def write_features(features: DataFrame, folder: str, mode: str = "append") -> None:
    """Feature sequences, partitioned by their use (``mode`` is 'train' or 'infer')."""
    features.write.mode(mode).partitionBy("mode").parquet(folder)
