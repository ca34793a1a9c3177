"""Quality rules with host-level verdicts.

Every document is measured once, whole. Rule failures are counted by host, the rates are shrunk towards a beta prior
fitted to all hosts by moments, and the shrunk rate comes back to the documents as prior odds of being junk: a failed
rule of a document weighs as evidence on top of it. A document without a failed rule is always kept.

Defined cases: a null or empty text has no words (and fails the base rules); null hosts form one host; repeated rows
are judged one by one and count one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm import flat
from punctual.llm.tables import saved, text_key

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
SYMBOLS = b"#*$%&|<>"

#: A host without any evidence: weight of the prior when all hosts have the same rate.
WEAKEST_PRIOR = 2.0
#: log-odds that one failed rule adds.
EVIDENCE = 3.0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")
_SCHEMA = "doc_id long, text_key long, host string, " + ", ".join(f"{m} long" for m in MEASURES)


def _measured(batches):
    fields = [pa.field("doc_id", pa.int64()), pa.field("text_key", pa.int64()), pa.field("host", pa.string())]
    schema = pa.schema(fields + [pa.field(m, pa.int64()) for m in MEASURES])
    symbol, upper, lower, tail = (np.zeros(256, bool) for _ in range(4))
    symbol[list(SYMBOLS)] = True
    upper[65:91] = True
    lower[97:123] = True
    tail[0x80:0xC0] = True
    for batch in flat.blocks(batches, "text"):
        n = batch.num_rows
        data, offsets = flat.flat(batch.column("text"))
        sums = flat.prefix(data)
        start, end, text = flat.words(data, offsets)

        def count(marks):
            total = np.concatenate([[0], np.cumsum(marks)])
            return total[offsets[1:]] - total[offsets[:-1]]

        blank = flat.BLANK[data]
        got = {
            "n_words": np.bincount(text, minlength=n),
            "word_chars": count(~blank & ~tail[data]),
            "n_symbols": count(symbol[data]),
            "n_upper": count(upper[data]),
            "n_lower": count(lower[data]),
        }
        a, b, owner = flat.runs(data != 10, offsets)
        wordy = np.concatenate([[0], np.cumsum(~blank)])
        filled = wordy[b] > wordy[a]
        owner, line = owner[filled], flat.spans(sums, a[filled], b[filled])
        order = np.lexsort((line, owner))
        again = (owner[order][1:] == owner[order][:-1]) & (line[order][1:] == line[order][:-1])
        got["n_lines"] = np.bincount(owner, minlength=n)
        got["n_dup_lines"] = np.bincount(owner[order][1:][again], minlength=n)
        got["n_repeat_words"] = _repeated(flat.spans(sums, start, end), text, n)
        same = {c: batch.column(c) for c in ("doc_id", "text_key", "host")}
        yield flat.rows(schema, **same, **got)


def _repeated(word: np.ndarray, text: np.ndarray, n: int, width: int = 3) -> np.ndarray:
    """Words of each text inside windows of ``width`` words that its text has twice or more."""
    if len(word) < width:
        return np.zeros(n, np.int64)
    whole = text[width - 1 :] == text[: 1 - width]
    at = np.flatnonzero(whole)
    key = flat.mix(flat.windows(word, width)[at] ^ (text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(word) + 1, np.int64)
    np.add.at(steps, at[twice], 1)
    np.add.at(steps, at[twice] + width, -1)
    covered = np.cumsum(steps[:-1]) > 0
    return np.bincount(text[covered], minlength=n)


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, text_key, host and the measures of every document."""
    narrow = docs.select("doc_id", text_key(), F.col(host).cast("string").alias("host"), "text")
    return narrow.mapInArrow(_measured, _SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def failures() -> Column:
    """How many of the rules a document fails, the base rules included."""
    rules = [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"),
        10 * F.col("n_symbols") > F.col("n_words"),
        100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        F.col("n_upper") > F.col("n_lower"),
    ]
    return sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))


def host_rates(measured: DataFrame) -> DataFrame:
    """host, docs, failed, and rate: the share of failing documents, shrunk by a beta prior that moments of all hosts give."""
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), F.sum((failures() > 0).cast("long")).alias("failed")
    )
    raw = F.col("failed") / F.col("docs")
    one = hosts.agg(F.avg(raw).alias("mean"), F.var_pop(raw).alias("variance")).first()
    mean, variance = one.mean if one.mean is not None else 0.5, one.variance or 0.0
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    weight = max(mean * (1 - mean) / variance - 1, WEAKEST_PRIOR) if variance > 0 else None
    if weight is None:  # all hosts alike: their common rate
        return hosts.withColumn("rate", F.lit(mean))
    return hosts.withColumn("rate", (F.col("failed") + mean * weight) / (F.col("docs") + weight))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Every document with its measures, ``base_failed``, ``host_rate`` and ``kept``."""
    measured = saved(measure(docs, host), "measured")
    rates = host_rates(measured).select(F.col("host").alias("of_host"), F.col("rate").alias("host_rate"))
    odds = F.log(F.col("host_rate") / (1 - F.col("host_rate"))) + EVIDENCE * failures()
    return (
        measured.join(rates, F.col("host").eqNullSafe(F.col("of_host")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~base_failed() & ((failures() == 0) | (odds < 0)))
        .drop("of_host")
    )
