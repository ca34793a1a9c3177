"""Short codes of vectors: each vector is cut into parts, each part coded by its nearest entry of a codebook.

The codebooks come from rounds of k-means in whole numbers, by ball k-means. The parts that an entry owns lie in a ball
round it; the radius is the largest distance of its parts. Only entries whose distance from it is at most twice the
radius can be nearer to any of its parts: its neighbours. A part in the stable core, nearer to its entry than half the
way to the nearest neighbour, keeps its entry unseen. The others lie in rings: a part needs the neighbours that are at
most twice its own distance away, which are the first so many in the entry's list by distance. What is left out is
strictly farther, so the result is that of comparing all, ties included. Each block of a task has its own balls round
the entries that are common to all: smaller balls, and no pass over the table for the radii.

A round reads the table with the codes of the last one, and writes it with new codes, and for each task the sums and
counts of its parts by entry, which Spark adds up. Only codebooks pass through the driver: parts x entries rows,
64 times the numbers of one vector.

Defined cases: rows whose vector is null or has a component that is null or not finite are left out. Rows are told
apart as rows, equal vectors and repeated ids too; null ids come last. The first vector by id whose length is a positive
multiple of ``parts`` fixes the length; rows of another length stay, with null code and error. With fewer rows than
entries the codebooks are shorter; without rows the result is empty. A null label equals a null label. Components
so large that squared distances leave 64 bits fail the job, as do such sums of errors. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import flat
from punctual.llm.tables import saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block.
BLOCK = 1 << 13

_TABLE = "vec_id long, label {label}, v array<long>, code binary, error long, part int, entry int, n long, sums array<long>"


def _whole(scale: int):
    """Vectors in whole numbers; those with a null or a number that is not finite are left out."""

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            sizes = pa.compute.list_value_length(column)
            here = np.asarray(sizes.is_valid())
            batch, column = batch.filter(pa.array(here)), column.filter(pa.array(here))
            if not batch.num_rows:
                continue
            values = column.flatten()
            x = np.floor(np.asarray(values.cast(pa.float64()).fill_null(np.nan)) * scale)
            if (np.abs(x[np.isfinite(x)]) >= 2.0**62).any():
                raise OverflowError("a component times the scale leaves 64 bits")
            size = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
            ends = np.cumsum(size)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = odd[ends] == odd[ends - size]
            inner = np.repeat(good, size)
            v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[good])]), pa.int32()), pa.array(x[inner].astype(np.int64)))
            rest = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([rest.column("vec_id"), rest.column("label"), v], ["vec_id", "label", "v"])

    return run


class Balls:
    """One part's entries (k x w), with every entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None] - entries[None]) ** 2).sum(2)
        np.fill_diagonal(apart, -1)
        rank = np.argsort(apart, 1, kind="stable")  # itself first
        self.near = rank[:, 1:]
        self.apart = np.take_along_axis(apart, self.near, 1)

    def assign(self, x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (the lower of equals) and squared distance of every row of ``x``, from a first ``owner`` each."""
        own = ((x - self.entries[owner]) ** 2).sum(1)
        radius = np.full(len(self.entries), -1)
        np.maximum.at(radius, owner, own)
        # Neighbours of each ball, and of them those within twice the part's own distance: none in the stable core.
        neighbours = np.where(radius >= 0, (self.apart <= 4 * radius[:, None]).sum(1), 0)
        rings = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(neighbours[owner])
        for k in range(int(neighbours.max(initial=0))):
            open_ = open_[self.apart[owner[open_], k] <= 4 * own[open_]] if k < self.apart.shape[1] else open_[:0]
            if not len(open_):
                break
            rings[open_] = k + 1
        best, least = owner.copy(), own.copy()
        inside = np.flatnonzero(rings)
        for k in range(int(rings.max(initial=0))):
            inside = inside[rings[inside] > k]
            other = self.near[owner[inside], k]
            far = ((x[inside] - self.entries[other]) ** 2).sum(1)
            better = (far < least[inside]) | ((far == least[inside]) & (other < best[inside]))
            best[inside[better]], least[inside[better]] = other[better], far[better]
        return best, least


def _round(books: list[np.ndarray], kind: pa.DataType):
    """New codes and errors of every row, and at the end of a task the sums and counts of its parts by entry."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]
    most = max(int(np.abs(b).max()) for b in books)

    def run(batches):
        fields = [("vec_id", pa.int64()), ("label", kind), ("v", pa.list_(pa.int64())), ("code", pa.binary()), ("error", pa.int64())]
        schema = pa.schema(fields + [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        balls = [Balls(b) for b in books]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n, v = batch.num_rows, batch.column("v")
                fits = np.asarray(pa.compute.equal(pa.compute.list_value_length(v), parts * width))
                x = np.asarray(v.filter(pa.array(fits)).flatten()).reshape(-1, parts, width)
                if len(x) and parts * width * (int(np.abs(x).max()) + most) ** 2 >= 1 << 60:
                    raise OverflowError("squared distances leave 64 bits")
                m = len(x)
                before = batch.column("code").filter(pa.array(fits))
                before = np.frombuffer(b"".join(before.to_pylist()), np.uint8).reshape(m, parts) if not before.null_count else np.zeros((m, parts), np.uint8)
                code, error = np.empty((m, parts), np.uint8), np.zeros(m, np.int64)
                for p in range(parts):
                    best, least = balls[p].assign(x[:, p], before[:, p].astype(np.int64))
                    np.add.at(sums[p], best, x[:, p])
                    counts[p] += np.bincount(best, minlength=entries)
                    code[:, p], error = best, error + least
                place = np.cumsum(fits) - 1
                codes = [code[k].tobytes() if f else None for k, f in zip(place, fits)]
                errors = pa.array(error[place] if m else np.zeros(n, np.int64), mask=~fits)
                none = {c: pa.nulls(n, schema.field(c).type) for c in ("part", "entry", "n", "sums")}
                same = {c: batch.column(c) for c in ("vec_id", "label", "v")}
                yield flat.rows(schema, code=pa.array(codes, pa.binary()), error=errors, **same, **none)
        p, e = np.nonzero(counts)
        none = {c: pa.nulls(len(p), schema.field(c).type) for c in ("vec_id", "label", "v", "code", "error")}
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * width + 1, width), pa.int32()), pa.array(sums[p, e].ravel()))
        yield flat.rows(schema, part=p.astype(np.int32), entry=e.astype(np.int32), n=counts[p, e], sums=lists, **none)

    return run


def _first(table: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The codebooks to start from: the parts of the first vectors by id."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    cut = table.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    one = cut.orderBy(*order).select(F.size("v").alias("n")).first()
    if one is None:
        return []
    chosen = cut.filter(F.size("v") == one["n"]).orderBy(*order).select("v").limit(entries).collect()
    whole = np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), parts, -1)
    return [whole[:, p] for p in range(parts)]


def codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding"
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, v, code, error) of every kept row, and the codebooks by part: ``code`` has one byte a part."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry is one byte")
    label = dict(vectors.dtypes)["label"]
    columns = _TABLE.format(label=label)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).alias("vector"))
    kept = saved(kept.mapInArrow(_whole(scale), f"vec_id long, label {label}, v array<long>"), "whole")
    books = _first(kept, parts, entries)
    table = kept.select("vec_id", "label", "v", F.lit(None).cast("binary").alias("code"))
    if not books:
        return table.withColumn("error", F.lit(None).cast("long")), []
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(vectors.schema["label"].dataType)
    for k in range(rounds + 1):
        told = saved(table.mapInArrow(_round(books, kind), columns), "round")
        table = told.filter("part is null").select("vec_id", "label", "v", "code", "error")
        if k == rounds:
            break
        width = books[0].shape[1]
        added = [F.sum(F.col("sums")[c].cast("decimal(38,0)")).alias(f"c{c}") for c in range(width)]
        totals = told.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *added)
        for r in totals.collect():  # one row an entry that is used
            books[r["part"]][r["entry"]] = [int(r[f"c{c}"]) // r["n"] for c in range(width)]
    return table, books


def code_text(code: str = "code"):
    """Two lower-case hexadecimal digits a part."""
    return F.lower(F.hex(code))


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place, parted by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the sum of the errors of all rows with the same label, nulls being alike."""
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
