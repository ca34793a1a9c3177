"""Reading the inputs and writing what lies between two jobs."""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.session import fresh_folder

# White space that parts words: blank and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table in the shared folder: later jobs read it, whatever executors are lost."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else: texts of ASCII alone take the fast path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_key() -> Column:
    """With the id, this tells rows apart whose ids repeat."""
    return F.xxhash64("text").alias("text_key")


def rows_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``keys`` (doc_id, text_key)."""
    keys = keys.select(F.col("doc_id").alias("_of_doc"), F.col("text_key").alias("_of_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_of_doc")) & (F.xxhash64("text") == F.col("_of_text"))
    return docs.join(keys, same, "left_semi")


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def released(spark: SparkSession) -> None:
    """Let go of what finished jobs left on disk: Spark drops the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark._jvm.System.gc()
