"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.tables import saved


def components(links: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """(node, component) for every end of ``links`` (a, b): the component is the least node reachable.

    Each round points all larger neighbours of a node, then the node's smaller ones, at the least of them; the number
    of rounds grows with the logarithm of the longest chain. Aggregates and joins only: a node with very many links
    is folded map-side and never gathered.
    """
    edges = saved(_ordered(links), "edges")
    before = _print(edges)
    while True:
        edges = saved(_small_star(saved(_large_star(edges), "large")), "small")
        now = _print(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("b").alias(node), F.col("a").alias(component))
    return stars.unionByName(edges.select(F.col("a").alias(node), F.col("a").alias(component)).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _print(edges: DataFrame) -> tuple:
    one = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")))
    return tuple(one.first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _ordered(both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    # a < b: the smaller neighbours of b are its a's.
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return _ordered(
        joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
        .unionByName(least.select(F.col("m").alias("a"), F.col("b").alias("b")))
    )
