"""Models over trip sequences: boosted trees, a count-based next-token model, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import PAD, Layout
from ..schemas import feature_column
from ..session import fresh_folder
from .features import token_columns, width_of

# ---- boosted trees --------------------------------------------------------------------------------------------------


def with_columns_of(examples: DataFrame, width: int) -> DataFrame:
    return examples.select("*", *token_columns(width))


def fit_tree(examples: DataFrame, rounds: int = 20, depth: int = 5, seed: int = 0) -> PipelineModel:
    """Boosted regression trees on the masked token columns; ``label`` is the delay change in minutes."""
    width = width_of(examples)
    assemble = VectorAssembler(inputCols=[feature_column(i) for i in range(width)], outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assemble, trees]).fit(with_columns_of(examples, width))


def predict_tree(model: PipelineModel, examples: DataFrame) -> DataFrame:
    names = model.stages[0].getInputCols()
    return model.transform(with_columns_of(examples, len(names))).drop("features", *names)


def error_metrics(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Squared, absolute and largest error, and the range and mean of the predictions, in one aggregate."""
    error = F.col(label) - F.col(prediction)
    return predicted.agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.max(F.abs(error)).alias("max_error"),
        F.max(prediction).alias("max_prediction"),
        F.min(prediction).alias("min_prediction"),
        F.avg(prediction).alias("mean_prediction"),
    )


def largest_residuals(
    predicted: DataFrame, ties: list[str], k: int = 30, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """The k largest signed errors; Spark keeps k rows per task before the final order."""
    error = F.col(label) - F.col(prediction)
    return predicted.withColumn("err", error).orderBy(F.desc("err"), *ties).limit(k)


# ---- next-token model -----------------------------------------------------------------------------------------------

# Contexts from the most general to the most specific; each is a list of columns of ``transitions``.
LEVELS = [["prev"], ["before", "prev"], ["route", "hour", "before", "prev"]]


def transitions(sequences: DataFrame) -> DataFrame:
    """Every next-token target that is not padding, with its context. ``before`` is -1 at the second token."""
    places = F.sequence(F.lit(1), F.size("tokens") - 1)
    targets = F.filter(places, lambda j: F.get("tokens", j) != PAD)
    at = F.explode(targets).alias("place")
    rows = sequences.select("tokens", at)

    def earlier(index: int) -> Column:
        return F.when(F.col("place") > index, F.get("tokens", F.lit(index))).otherwise(F.lit(-1))

    return rows.select(
        F.get("tokens", F.col("place")).alias("next"),
        F.get("tokens", F.col("place") - 1).alias("prev"),
        F.when(F.col("place") >= 2, F.get("tokens", F.col("place") - 2)).otherwise(F.lit(-1)).alias("before"),
        earlier(1).alias("route"),
        earlier(3).alias("hour"),
    )


def count_tokens(sequences: DataFrame) -> list[DataFrame]:
    """The model: per level the counts of next tokens by context, each from the one more specific.

    Frequent contexts fold on the map side; the result is bounded by the number of distinct contexts.
    """
    return with_coarser(transitions(sequences).groupBy(*LEVELS[-1], "next").agg(F.count(F.lit(1)).alias("n")))


def with_coarser(finest: DataFrame, kept: Callable[[DataFrame, int], DataFrame] = lambda table, level: table) -> list[DataFrame]:
    """The tables of all levels, folded from the most specific one. Each is what ``kept`` makes of it: stored there, a table
    is folded once, from the stored one, however often it is read."""
    tables = [finest]
    for level, context in reversed(list(enumerate([[], *LEVELS[:-1]]))):
        tables.insert(0, kept(tables[0].groupBy(*context, "next").agg(F.sum("n").alias("n")), level))
    return tables


def cross_entropy(model: list[DataFrame], held_out: DataFrame, layout: Layout) -> DataFrame:
    """Mean negative log probability over the non-padding targets, for the whole model and for token
    frequencies alone.

    Every level is mixed with the level below: p(x|c) = (n(c,x) + k(c) p(x|shorter c)) / (n(c) + k(c)), where k(c)
    is the number of distinct tokens seen after c; the lowest is (n(x) + 1) / (n + vocabulary). Equal targets are
    folded before they meet the model, so a context that occurs everywhere is looked up once per distinct target.
    The scores are written after every level: a task holds the sorts of two joins, not of all levels at once.
    """
    finest = LEVELS[-1]
    scored = transitions(held_out).groupBy(*finest, "next").agg(F.count(F.lit(1)).alias("cases"))
    total = model[0].agg(F.sum("n")).scalar()
    zero = F.lit(0)
    scored = (
        scored.join(model[0], "next", "left")
        .withColumn("p", (F.coalesce("n", zero) + 1.0) / (F.coalesce(total, zero) + float(layout.size)))
        .withColumn("p0", F.col("p"))
        .drop("n")
    )
    for level, table in zip(LEVELS, model[1:]):
        sums = table.groupBy(*level).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        mixed = (F.coalesce("n", zero) + F.col("kinds") * F.col("p")) / (F.col("all") + F.col("kinds"))
        scored = (
            scored.join(table, [*level, "next"], "left")
            .join(sums, level, "left")
            .withColumn("p", F.when(F.col("all").isNull(), F.col("p")).otherwise(mixed))
            .drop("n", "all", "kinds")
        )
        scored = _written(scored)
    cases = F.col("cases")
    return scored.agg(
        F.sum("cases").alias("targets"),
        (F.sum(-F.log("p") * cases) / F.sum(cases)).alias("loss"),
        (F.sum(-F.log("p0") * cases) / F.sum(cases)).alias("unigram_loss"),
    )


def _written(df: DataFrame) -> DataFrame:
    path = fresh_folder(df.sparkSession, "scores")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def most_likely(table: DataFrame, context: list[str]) -> DataFrame:
    """The most frequent next token per context; the lowest token wins ties."""
    best = F.max_by("next", F.struct("n", -F.col("next"))).alias("best")
    return table.groupBy(*context).agg(best)


def _by_delta(table: DataFrame, keys: list[str]) -> DataFrame:
    """Most likely token per (keys, token before the stop), folded to one map per key.

    Before a stop stands a delta or, at the first stop, the hour, so a map has at most 31 + 24 entries.
    """
    best = most_likely(table, [*keys, "before"])
    entry = F.struct("before", "best")
    folded = F.map_from_entries(F.collect_list(entry)).alias("choices")
    return best.groupBy(*keys).agg(folded)


def fill_sequences(model: list[DataFrame], sequences: DataFrame, layout: Layout) -> DataFrame:
    """Replace every skip token, left to right, by the most likely token given all that stands before it.

    The token to fill follows a stop, and only the last delta among its context is itself a prediction. So the
    choices are fetched per place for all last deltas at once (three joins, no loop over places), and the
    left-to-right dependence is folded inside the row. Filling ends at the padding. ``key`` columns of
    ``sequences`` are kept; ``tokens`` stays and ``answer`` is added. Repeated messages are asked once and each answered.
    """
    keyed = sequences.withColumn("_key", F.struct("id", "seq", "tokens"))
    skip = F.lit(layout.skip)
    places = F.filter(
        F.sequence(F.lit(2), F.size("tokens") - 1), lambda j: F.get("tokens", j) == skip
    )
    distinct = keyed.select("_key", "tokens").distinct()
    asked = distinct.select("_key", "tokens", F.explode(places).alias("place")).select(
        "_key",
        "place",
        F.get("tokens", F.col("place") - 1).alias("prev"),
        F.get("tokens", F.lit(1)).alias("route"),
        F.get("tokens", F.lit(3)).alias("hour"),
    )
    after_stop = F.col("prev").between(layout.stop0, layout.weekday0 - 1)
    exact = _by_delta(model[3].filter(after_stop), ["route", "hour", "prev"]).withColumnRenamed("choices", "exact")
    local = _by_delta(model[2].filter(after_stop), ["prev"]).withColumnRenamed("choices", "local")
    plain = most_likely(model[1], ["prev"]).withColumnRenamed("best", "plain")
    overall = model[0].agg(F.max_by("next", F.struct("n", -F.col("next")))).scalar()
    # Equal questions are folded first: the joins meet each distinct (route, hour, stop) once.
    questions = (
        asked.select("route", "hour", "prev")
        .distinct()
        .join(exact, ["route", "hour", "prev"], "left")
        .join(local, "prev", "left")
        .join(plain, "prev", "left")
        .withColumn("plain", F.coalesce("plain", overall))
    )
    choices = F.struct("place", F.struct("exact", "local", "plain"))
    answers = (
        asked.join(questions, ["route", "hour", "prev"])
        .groupBy("_key")
        .agg(F.map_from_entries(F.collect_list(choices)).alias("by"))
    )

    def step(done: Column, place: Column) -> Column:
        token = F.get("tokens", place)
        last = F.get(done, place - 2)
        choice = F.try_element_at("by", place)
        guess = F.coalesce(
            F.try_element_at(choice["exact"], last), F.try_element_at(choice["local"], last), choice["plain"]
        )
        return F.concat(done, F.array(F.when(token == skip, guess).otherwise(token)))

    length = F.array_position("tokens", PAD)
    stop = F.when(length > 0, length.cast("int") - 1).otherwise(F.size("tokens"))
    order = F.when(F.col("_stop") > 0, F.sequence(F.lit(0), F.col("_stop") - 1))
    start = F.array().cast("array<int>")
    return (
        keyed.join(answers, "_key", "left")
        .withColumn("_stop", stop)
        .withColumn("answer", F.coalesce(F.aggregate(order, start, step), start))
        .drop("_key", "by", "_stop")
    )


def save_counts(model: list[DataFrame], metrics: DataFrame, path: str) -> None:
    """Store the model tables with the metrics beside them."""
    for i, table in enumerate(model):
        table.write.mode("overwrite").parquet(f"{path}/level={i}")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_counts(spark, path: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/level={i}") for i in range(len(LEVELS) + 1)]


def save_tree(model: PipelineModel, metrics: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def dataset_counts(sequences: DataFrame) -> DataFrame:
    """Samples and distinct tokens per split, and the longest sequence without padding."""
    filled = F.filter("tokens", lambda x: x != PAD)
    lengths = sequences.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"), F.max(F.size(filled)).alias("longest")
    )
    words = (
        sequences.select("split", F.explode(F.array_distinct("tokens")).alias("token"))
        .distinct()
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("tokens_used"))
    )
    return lengths.join(words, "split", "left")
