"""Live predictions across batches and across a better model; visits in sliding windows."""

import json

import pytest
from pyspark.sql import functions as F

from punctual.functions.vocabulary import Layout
from punctual.operators.model import count_tokens
from punctual.sources import readers
from punctual.streaming import jobs, views

LAYOUT = Layout()


def sequences(spark, delta, n):
    row = [31, 34, 150, 160, 48, 15, 49, delta, 50, delta, 32] + [33] * 64
    return spark.createDataFrame([(row,)] * n, "tokens array<int>")


def test_a_better_model_takes_effect_at_the_next_batch_and_repeats_are_carried(spark, tmp_path):
    models = views.BestModel(spark, str(tmp_path / "models"))
    with pytest.raises(ValueError):
        models.get()
    test = sequences(spark, 18, 2)
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    ask = "v:" + ",".join(map(str, [31, 34, 150, 160, 48, 15, 49, LAYOUT.skip, 50, LAYOUT.skip] + [33] * 65))
    batches = [[("v", 1, "v"), ("v", 2, ask), ("v", 3, "v")], [("v", 4, "v"), ("v", 5, ask), ("w", 6, "w")], [("v", 7, ask), ("v", 8, "v")]]
    for k, rows in enumerate(batches):
        if k != 2:
            train = sequences(spark, 17 + k, 3)  # the second model fits the test sequences
            views.publish_counts(models.registry, count_tokens(train), train.withColumn("split", F.lit("train")), test, LAYOUT)
        else:
            train = sequences(spark, 12, 3)
            views.publish_counts(models.registry, count_tokens(train), train.withColumn("split", F.lit("train")), test, LAYOUT)  # worse
        spark.createDataFrame(rows, "id string, seq bigint, message string").coalesce(1).write.mode("append").parquet(landing)
        stream = readers.stream_messages(spark, landing)
        jobs.run_to_end(views.start_live_predictions(stream, models.get, LAYOUT, out, log, True))
    got = sorted((r.seq, r.kind, json.loads(r.value)["delay"]) for r in spark.read.parquet(f"{out}/topic").collect())
    first, better = [0, 2, 4], [0, 3, 6]
    assert got == [(2, "fresh", first), (3, "repeated", first), (4, "repeated", first), (5, "fresh", better), (7, "fresh", better), (8, "repeated", better)]
    now = views.current_predictions(spark, out).collect()
    assert [(r.id, r.seq, r.delay) for r in now] == [("v", 7, better)]


def test_visits_in_sliding_windows_and_late_ones(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    hour = 1_700_000_000 // 3600 * 3600
    batches = [[0, 10, 1000, 3700], [4 * 3600, 3800], [200, 4 * 3600 + 5]]  # 3800 is late but within; 200 is beyond
    for seconds in batches:
        frame = spark.createDataFrame([(hour + s,) for s in seconds], "s bigint").select(F.timestamp_seconds("s").alias("at"))
        frame.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("at timestamp").parquet(landing)
        jobs.run_to_end(views.start_visit_windows(stream, out, log, late="1 hour", available_now=True))
    got = {r.start - hour: r.visits for r in views.visits_now(spark, out).collect()}
    want = {}
    for s in [0, 10, 1000, 3700, 4 * 3600, 3800, 4 * 3600 + 5]:
        for k in range(4):
            want[s // 900 * 900 - 900 * k] = want.get(s // 900 * 900 - 900 * k, 0) + 1
    assert got == want


def test_the_loss_is_that_of_the_stored_tables(spark, tmp_path, monkeypatch):
    """The tables were folded from the sequences anew wherever the loss reads them, and once more to be stored."""
    read, loss = [], views.cross_entropy

    def spied(model, *rest):
        read.extend(path for t in model for path in t.inputFiles())
        return loss(model, *rest)

    monkeypatch.setattr(views, "cross_entropy", spied)
    models = views.BestModel(spark, str(tmp_path / "models"))
    train, test = sequences(spark, 17, 3), sequences(spark, 18, 2)
    for level in (0, 3):
        model = views.levels_up_to(count_tokens(train), level)
        views.publish_counts(models.registry, model, train.withColumn("split", F.lit("train")), test, LAYOUT)
        want = loss(model, test, LAYOUT).first()
        got = models.registry.pointers().orderBy(F.desc("version")).first()
        assert read and all(f"{tmp_path}/models/version=" in path for path in read)
        assert got["metrics"]["loss"] == pytest.approx(want["loss"]) and got["metrics"]["targets"] == want["targets"]
