"""Mixing sources to target weights by the cube method.

A source with target T and size S takes every document T/S times on average. The whole part is taken for certain; the
fraction is drawn balanced: inclusion probabilities move along directions that keep two totals of the source, documents
and words, until they are 0 or 1. Three open documents always leave one such direction. Groups of a source move on
their own and leave at most two open documents each; these meet in fewer groups, level by level. The last flight of a
source stops at a dozen open documents, and the landing takes the best of their subsets. No step holds more than a block of narrow rows, and the draw depends on the ids alone.

Defined cases: a null or empty text has size 0; null sources form one source, last in order; repeated rows are drawn
one by one; a source without words takes nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.tables import WORD, pieces, saved

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Rows that one group of the flight holds, on average.
BLOCK = 4096
#: Up to so many sources their targets are worked out on the driver and sent to every task; beyond, in Spark.
MOST_SOURCES = 100_000
#: Open documents of a source that the landing decides at once, by trying all subsets.
LANDING = 12
EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a number that fixes the row's place in the draw."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("place"))


def targets(totals: list[tuple[str | None, int]], weights=WEIGHTS, most=MOST_REPEATS) -> dict[str | None, float]:
    """Words to take by source: shares by weight, at most ``most`` times what a source has, the excess reshared."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    have, out, rest = dict(order), {}, float(sum(n for _, n in order))
    free = set(weight)
    while free:
        share = rest / sum(weight[s] for s in free)
        full = [s for s in weight if s in free and share * weight[s] > most * have[s]]
        if not full:
            out |= {s: share * weight[s] for s in free}
            break
        for s in full:
            out[s] = float(most * have[s])
            rest -= out[s]
            free.discard(s)
    return out


def _move(size: list[float], p: list[float], draw, leave: int) -> None:
    """Flight: move ``p`` in place, three open units at a time, until at most ``leave`` (two or more) are open."""
    still = [k for k in range(len(p)) if EPS < p[k] < 1 - EPS]
    left = len(still)
    if left <= leave:
        return
    a, b, c = still[0], still[1], still[2]
    at = 3
    while True:
        x, y, z = size[a], size[b], size[c]
        u, v, w = y - z, z - x, x - y  # sums to 0 and is orthogonal to the sizes
        if u == 0 and v == 0 and w == 0:
            u, v = 1.0, -1.0
        up = down = float("inf")
        for q, d in ((p[a], u), (p[b], v), (p[c], w)):
            if d > 0:
                up, down = min(up, (1 - q) / d), min(down, q / d)
            elif d < 0:
                up, down = min(up, q / -d), min(down, (1 - q) / -d)
        step = up if next(draw) * (up + down) < down else -down
        p[a] += step * u
        p[b] += step * v
        p[c] += step * w
        kept = []
        for k in (a, b, c):
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = float(round(p[k]))
                left -= 1
            else:
                kept.append(k)
        while len(kept) < 3 and at < len(still):
            kept.append(still[at])
            at += 1
        if left <= leave or len(kept) < 3:
            return
        a, b, c = kept


def _land(size: list[float], p: list[float]) -> None:
    """Decide all open units in place: of all subsets the one whose words, then whose number, come nearest."""
    open_ = [k for k in range(len(p)) if EPS < p[k] < 1 - EPS]
    sizes, shares = np.array([size[k] for k in open_]), np.array([p[k] for k in open_])
    subsets = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words, number = abs(subsets @ sizes - shares @ sizes), abs(subsets.sum(1) - shares.sum())
    for k, bit in zip(open_, subsets[np.lexsort((number, words))[0]].tolist()):
        p[k] = float(bit)


def _flight(last: bool):
    def step(rows):
        size, place = (rows.column(c).to_numpy() for c in ("size", "place"))
        order = np.lexsort((place, size))
        rows, size = rows.take(order), size[order].astype(float).tolist()
        lots = np.random.default_rng(int(np.bitwise_xor.reduce(place) & 0x7FFFFFFF) + len(place))
        p = rows.column("p").to_pylist()
        _move(size, p, iter(lots.random(len(p) + 4).tolist()), LANDING if last else 2)
        if last:
            _land(size, p)
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return step


def ranked(per: DataFrame) -> DataFrame:
    """``per`` with ``rank``, the place of the source by code point, null last: counted in ranges and over the ranges."""
    ranges = saved(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ranges")
    last = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("size"))  # one row a partition
    offsets = sizes.select("range", F.coalesce(F.sum("size").over(last), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("inside", inside).join(offsets, "range").withColumn("rank", F.col("offset") + F.col("inside"))


def planned(per: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """source, n, rows and ``target`` as ``targets`` has it, for any number of sources.

    Each round is one sum over the sources: those that a share would fill beyond their limit are full, the rest is shared
    again. Shares only grow, so full sources stay full, and the rounds end when no more are.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    per = saved(ranked(per).select("source", "n", "rows", weight.alias("weight")), "planned")
    limit = F.col("n") * float(most)
    total = float(per.agg(F.sum("n")).first()[0] or 0)
    share, known = 0.0, -1
    while True:
        full = F.lit(share) * F.col("weight") > limit
        got = per.agg(
            F.count_if(full).alias("full"), F.sum(F.when(full, limit)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free")
        ).first()
        if got.full == known or not got.free:
            break
        share, known = (total - (got.held or 0.0)) / got.free, got.full
    return per.select("source", "n", "rows", F.least(F.lit(share) * F.col("weight"), limit).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK, most_sources: int = MOST_SOURCES) -> DataFrame:
    """doc_id, source, size, source_size, target, and ``taken``: the words that the mix takes of the document."""
    narrow = saved(sizes(docs), "sizes")
    spark = docs.sparkSession
    per = narrow.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    few = per.limit(most_sources + 1).collect()
    if len(few) <= most_sources:
        goal = targets([(r.source, r.n) for r in few], weights, most)
        plan = spark.createDataFrame(
            [(r.source, r.n, goal[r.source], (goal[r.source] / r.n) if r.n else 0.0, pieces(r.rows, block)) for r in few],
            "of_source string, source_size long, target double, times double, groups long",
        )
        plan, groups = F.broadcast(plan), max((pieces(r.rows, block) for r in few), default=1)
    else:
        times = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0).alias("times")
        parts = F.ceil(F.col("rows") / block).cast("long").alias("groups")
        plan = planned(per, weights, most).select(
            F.col("source").alias("of_source"), F.col("n").alias("source_size"), "target", times, parts
        )
        plan = saved(plan, "plan")
        groups = plan.agg(F.max("groups")).first()[0]
    known = narrow.join(plan, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    whole = F.floor(F.col("times") + EPS)
    known = known.withColumn("sure", whole.cast("long")).withColumn(
        "p", F.greatest(F.lit(0.0), F.col("times") - F.col("sure"))
    )
    schema = "doc_id long, source string, size long, place long, source_size long, target double, groups long, sure long, p double"
    columns = [c.split()[0] for c in schema.split(", ")]
    open_ = known.select(columns)
    done = []
    while True:
        moved = saved(
            open_.groupBy("source", F.pmod(F.xxhash64("place", F.lit(groups)), "groups").alias("part"))
            .applyInArrow(_flight(groups == 1), schema),
            "flight",
        )
        if groups == 1:
            done.append(moved)
            break
        settled = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
        done.append(moved.filter(settled))
        groups = pieces(groups * 2, block)
        open_ = moved.filter(~settled).withColumn("groups", F.ceil(F.col("groups") * 2 / block).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    taken = (F.col("size") * (F.col("sure") + F.round("p").cast("long"))).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", taken)
