"""Live views: the current prediction of every vehicle, and site visits in sliding windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vocabulary import Layout
from ..operators import decode
from ..operators.model import cross_entropy, dataset_counts, fill_sequences, load_counts, save_counts
from ..operators.serving import latest_row, resend_predictions
from .jobs import _stream_settings, _trigger, start_batches
from .keyed import KeyedTable, Registry

PREDICTION = "id string, seq bigint, delay array<int>, first_predicted_sequence int"


def publish_counts(registry: Registry, model: list[DataFrame], sequences: DataFrame, test: DataFrame | None, layout: Layout) -> int:
    """Store a next-token model as a version with its loss on held-out ``test`` sequences; the version.

    The loss is that of the stored tables: a table is read several times for it, and folded only once. Without ``test`` there
    is none: the version can be the newest one, but does not count for the best.
    """

    def measured(path: str) -> dict[str, float]:
        row = cross_entropy(load_counts(test.sparkSession, path), test, layout).first()
        return {"loss": row["loss"], "unigram_loss": row["unigram_loss"], "targets": row["targets"]}

    return registry.publish(lambda path: save_counts(model, dataset_counts(sequences), path), measured if test is not None else None)


def levels_up_to(model: list[DataFrame], level: int) -> list[DataFrame]:
    """A next-token model with contexts up to ``level``: the tables of longer contexts are empty."""
    return [t if i <= level else t.limit(0) for i, t in enumerate(model)]


class BestModel:
    """The published model with the least held-out loss, looked up anew in every batch."""

    def __init__(self, spark: SparkSession, folder: str, metric: str = "loss"):
        self.spark, self.registry, self.metric = spark, Registry(spark, folder), metric

    def get(self) -> list[DataFrame]:
        return self._load(self.registry.best(self.metric))

    def newest(self) -> list[DataFrame]:
        """The model published last, whatever its loss."""
        return self._load(self.registry.latest())

    def _load(self, path: str | None) -> list[DataFrame]:
        if path is None:
            raise ValueError("no model is published")
        return load_counts(self.spark, path)


def start_live_predictions(
    messages: DataFrame, model: Callable[[], list[DataFrame]], layout: Layout, folder: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Messages ``(id, seq, message)`` to predictions as JSON, fresh and repeated ones on one topic, ``folder``/topic.

    A sequence is filled and decoded; a bare id repeats the vehicle's last prediction, which may be of an earlier
    batch. The current prediction of every vehicle is a keyed table, ``folder``/current, that a batch updates by what
    it brings. ``model`` is asked once a batch, so a better model takes effect at a batch boundary.
    """
    spark = messages.sparkSession
    table = KeyedTable(spark, f"{folder}/current", "id", PREDICTION)
    shown = ["id", "seq", "delay", "first_predicted_sequence"]

    def told(df: DataFrame, kind: str) -> DataFrame:
        value = F.to_json(F.struct("id", "delay", "first_predicted_sequence"))
        return df.select("id", "seq", F.lit(kind).alias("kind"), value.alias("value"))

    def write(batch: DataFrame, batch_id: int) -> None:
        asked = decode.asked_sequences(batch).select("id", "seq", "tokens").persist()
        bare = decode.repeat_requests(batch).select("id", "seq")
        filled = fill_sequences(model(), asked, layout)
        fresh = decode.decode_delays(filled, layout.skip, filled="answer").select(*shown).persist()
        try:
            here = bare.select("id").distinct()
            known = fresh.unionByName(table.before(batch_id).join(here, "id", "left_semi").select(*shown))
            repeated = resend_predictions(bare, known)
            topic = told(fresh, "fresh").unionByName(told(repeated, "repeated"))
            topic.write.mode("overwrite").parquet(f"{folder}/topic/batch={batch_id}")
            table.put(batch_id, latest_row(fresh).select(*shown))
        finally:
            fresh.unpersist()
            asked.unpersist()

    return start_batches(messages, write, checkpoint, available_now)


def current_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The current prediction of every vehicle, as ``start_live_predictions`` has left it."""
    return KeyedTable(spark, f"{folder}/current", "id", PREDICTION).now()


WINDOWS = "start bigint, visits bigint"


def visit_windows(visits: DataFrame, length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """Visits (``at``, a timestamp) in sliding windows: ``start`` (epoch seconds) and ``visits``; for tables and streams."""
    counted = visits.groupBy(F.window("at", length, step)).agg(F.count(F.lit(1)).alias("visits"))
    return counted.select(F.unix_timestamp("window.start").alias("start"), "visits")


def start_visit_windows(
    visits: DataFrame, folder: str, checkpoint: str, late: str = "1 hour", length: str = "1 hour", step: str = "15 minutes", available_now: bool = False
) -> StreamingQuery:
    """Sliding windows over a stream of visits, to a keyed table (``folder``) with the current count of each window.

    Late data: a visit counts in every window that ends after the watermark, the latest visit seen by the batch before
    less ``late``; in windows that ended before it does not. So state holds the windows of the last ``length`` + ``late``.
    """
    table = KeyedTable(visits.sparkSession, folder, "start", WINDOWS)
    counted = visit_windows(visits.withWatermark("at", late), length, step)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.put(batch_id, batch)

    writer = counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    with _stream_settings(visits.sparkSession):
        return writer.trigger(**_trigger(available_now)).start()


def visits_now(spark: SparkSession, folder: str) -> DataFrame:
    """The windows as ``start_visit_windows`` has left them."""
    return KeyedTable(spark, folder, "start", WINDOWS).now()
