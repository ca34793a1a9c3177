"""Previous and next event of the same key without a window over the whole key.

``lag`` over one key puts all of its events into one task. Here the window runs inside (key, block), with
blocks as fixed ranges of the unique order column, and the edge rows of the blocks are linked through one
summary row per (key, block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import BLOCK_ROWS, block_of


def with_previous(
    df: DataFrame, columns: list[str], key: str = "id", order: str = "seq", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``prev_<column>`` from the key's preceding row; null at its first row."""
    blocked = df.withColumn("_block", block_of(F.col(order), block_rows))
    w = W.partitionBy(key, "_block").orderBy(order)
    local = blocked.withColumn("_prev", F.lag(F.struct(*columns)).over(w))
    edges = (
        blocked.groupBy(key, "_block")
        .agg(F.max_by(F.struct(*columns), F.col(order)).alias("_edge"))
        .withColumn("_carry", F.lag("_edge").over(W.partitionBy(key).orderBy("_block")))
        .select(key, "_block", "_carry")
    )
    linked = local.join(edges, [key, "_block"]).withColumn("_prev", F.coalesce("_prev", "_carry"))
    return linked.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns])
