"""From predicted sequences back to delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import PAD, token_minutes

ALL_REACHED = 100
FIRST_DELTA = 5


def parse_messages(messages: DataFrame) -> DataFrame:
    """``id:t0,t1,...`` to ``(id, tokens)``; a bare id gives null tokens, meaning repeat the last prediction."""
    head = F.split("message", ":", 2)
    return messages.withColumn("id", F.get(head, F.lit(0))).withColumn(
        "tokens", F.transform(F.split(F.get(head, F.lit(1)), ","), lambda x: x.try_cast("int"))
    )


def repeat_requests(messages: DataFrame) -> DataFrame:
    """The bare ids among ``messages``, as ``parse_messages`` gives them. Told by the colon that they lack: no list of
    tokens is split to find out that there is one."""
    bare = messages.filter(F.coalesce(~F.contains("message", F.lit(":")), F.lit(True)))
    return bare.withColumn("id", F.col("message")).withColumn("tokens", F.lit(None).cast("array<int>"))


def asked_sequences(messages: DataFrame) -> DataFrame:
    """The messages with a sequence, as ``parse_messages`` gives them; each list is split once."""
    return parse_messages(messages.filter(F.contains("message", F.lit(":"))))


def first_predicted(tokens: Column, skip: int) -> Column:
    """Stop index of the first skip token, 100 if there is none."""
    at = F.array_position(tokens, skip) - 1
    return F.when(at >= 0, (F.floor((at - 3) / 2) - 1).cast("int")).otherwise(F.lit(ALL_REACHED))


def delta_steps(tokens: Column) -> Column:
    """Every second token from the first delta on, in minutes."""
    odd = F.filter(tokens, lambda x, i: (i >= FIRST_DELTA) & (i % 2 == 1))
    return F.transform(odd, token_minutes)


def running_total(values: Column) -> Column:
    """Sums up to each place, by one pass over the array."""
    start = F.struct(F.array().cast("array<int>").alias("sums"), F.lit(0).alias("total"))

    def step(done: Column, value: Column) -> Column:
        total = (done["total"] + value).cast("int")
        return F.struct(F.concat(done["sums"], F.array(total)).alias("sums"), total.alias("total"))

    return F.aggregate(values, start, step, lambda done: done["sums"])


def until_padding(tokens: Column) -> Column:
    at = F.array_position(tokens, PAD)
    return F.when(at > 0, F.slice(tokens, F.lit(1), (at - 1).cast("int"))).otherwise(tokens)


def decode_delays(sequences: DataFrame, skip: int, filled: str = "tokens") -> DataFrame:
    """Adds ``delay`` (minutes per stop) and ``first_predicted_sequence``.

    ``tokens`` tells what was asked, ``filled`` holds the answer. If something was asked the answer is decoded up to
    the padding, else the whole of ``tokens``.
    """
    asked = F.array_contains("tokens", skip)
    answer = F.when(asked, until_padding(F.col(filled))).otherwise(F.col("tokens"))
    return (
        sequences.withColumn("_steps", delta_steps(answer))
        .withColumn("delay", running_total(F.col("_steps")))
        .withColumn("first_predicted_sequence", first_predicted(F.col("tokens"), skip))
        .drop("_steps")
    )


def prediction_json(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        F.to_json(F.struct("id", "delay", "first_predicted_sequence")).alias("value")
    )
