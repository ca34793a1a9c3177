"""Timetables that change: snapshots folded to versions of single trips, and the version in force at each event.

A snapshot is a whole ``trips_nested`` with the time from which it holds, ``valid_from`` (epoch seconds). Most trips stay the
same from one snapshot to the next, so they are folded: a version of a trip lasts as long as its content does, and ends
where a snapshot lacks it. Downstream a version is a trip of its own, under the key ``trip_id@valid_from``; so a vehicle whose
trip changes under way starts a new run, with the new list of stops, and nothing else needs to know of versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_MARK = "@"


def fold_versions(snapshots: DataFrame) -> DataFrame:
    """Versions of trips with ``valid_from`` and ``valid_to`` (null: still valid), from snapshots with ``valid_from``.

    A repeated row of one snapshot counts once. Windows run inside a trip, over one row a snapshot. The contents are
    dealt by trip first, which serves every step after it, so they are shuffled once.
    """
    rest = [c for c in snapshots.columns if c not in ("trip_id", "valid_from")]
    content = F.struct(*rest)
    dates = sorted(row[0] for row in snapshots.select("valid_from").distinct().collect())  # a number a snapshot
    following = F.get(F.filter(F.array(*map(F.lit, dates)).cast("array<bigint>"), lambda d: d > F.col("valid_from")), F.lit(0))
    dealt = snapshots.repartition("trip_id")
    one = dealt.groupBy("trip_id", "valid_from").agg(F.max(content).alias("content")).withColumn("until", following)
    w = W.partitionBy("trip_id").orderBy("valid_from")
    goes_on = F.col("content").eqNullSafe(F.lag("content").over(w)) & (F.lag("until").over(w) == F.col("valid_from"))
    numbered = one.withColumn("fresh", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("version", F.sum("fresh").over(w))
    return (
        numbered.groupBy("trip_id", "version")
        .agg(
            F.min("valid_from").alias("valid_from"),
            F.when(F.count(F.when(F.col("until").isNull(), 1)) == 0, F.max("until")).alias("valid_to"),
            F.max("content").alias("content"),
        )
        .select("trip_id", *[F.col(f"content.{c}").alias(c) for c in rest], "valid_from", "valid_to")
    )


def version_key(trip_id: Column, valid_from: Column) -> Column:
    return F.concat_ws(_MARK, trip_id, valid_from.cast("string"))


def plain_trip(key: Column) -> Column:
    """The trip of a version key; other text stays as it is."""
    return F.regexp_replace(key, _MARK + r"-?\d+$", "")


def keyed_versions(versions: DataFrame) -> DataFrame:
    """The versions as ``trips_nested``, each a trip under its key."""
    key = version_key(F.col("trip_id"), F.col("valid_from"))
    return versions.withColumn("trip_id", key).drop("valid_from", "valid_to")


def in_force(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Events with the key of the version that is in force at their ``timestamp`` in place of ``trip_id``.

    An event of a trip that has no version then keeps its plain id, which is no key of any version. Joined on the
    trip; the few versions of a trip are told apart by time.
    """
    spans = versions.select(F.col("trip_id").alias("_trip"), "valid_from", "valid_to")
    at = F.col("timestamp")
    holds = (F.col("trip_id") == F.col("_trip")) & (F.col("valid_from") <= at) & (F.coalesce(at < F.col("valid_to"), F.lit(True)))
    key = F.coalesce(version_key(F.col("_trip"), F.col("valid_from")), F.col("trip_id"))
    found = F.when(F.col("_trip").isNotNull(), key).otherwise(F.col("trip_id"))
    return events.join(spans, holds, "left").withColumn("trip_id", found).drop("_trip", "valid_from", "valid_to")
