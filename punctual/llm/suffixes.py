"""Exact removal of long repeated passages, by a distributed difference cover.

A string of ``WIDTH`` bytes is repeated if it starts at two places of the input. The places are not sorted all at once,
as the disks of a cluster would have to hold many times the text. A difference cover of v = 183 keeps 14 of every 183
places as samples, so that for any two places there is a distance d < 183 at which both are samples (a cover of 3, the
usual triples, keeps two thirds of all places). Then:

1. Sort sampled prefixes: samples get the name of the 218 bytes that follow, short enough to lie inside every string of
   400 that begins less than 183 before. Names that only one sample has are dropped, with the text around them.
2. Recurse on names: the remaining samples are named anew by name and whole context, the 182 bytes before and the 400
   after. Where a context has a second sample, every string that begins in it is repeated.
3. Merge the remaining suffixes: one sample for each different context of a name is compared with the others. At each
   distance before the sample, strings of 400 are sorted and adjacent ones compared.

Samples at the same place of the cover are followed at one place of it only; pairs that lie so meet there as well.
Names with very many contexts are split by distance and string, and counted by a plain aggregation.

Equality is that of 64-bit polynomial hashes of the strings; names are cut to 48 bits, as what two strings share in
them is only looked at more closely. Memory is bounded by blocks of two megabytes, by buckets
whose number follows the size of the input, and by the longest single text.

Defined cases: a null text is empty; texts shorter than ``WIDTH`` lose nothing; repeated rows are copies of each other
and lose all they share; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import flat
from punctual.llm.tables import pieces, released, saved

WIDTH = 400
ORDER = 13
#: Bytes of text for each bucket of names, and contexts for each bucket of comparisons.
BUCKET_BYTES = 16 << 20
BUCKET_CONTEXTS = 1500
#: A name with more contexts than this is split.
MOST_CONTEXTS = 10_000

_U = np.uint64


def difference_cover(q: int) -> tuple[int, list[int]]:
    """v = q*q + q + 1 and q + 1 residues whose differences give every residue (Singer's sets; ``q`` prime).

    The powers of a root of an irreducible cubic over q elements are the points of a plane; those on a line are a cover.
    """
    v = q * q + q + 1
    for c0, c1, c2 in itertools.product(range(1, q), range(q), range(q)):
        a, line = (1, 0, 0), []
        for i in range(v):
            if a[2] == 0:
                line.append(i)
            a = (a[2] * c0 % q, (a[0] + a[2] * c1) % q, (a[1] + a[2] * c2) % q)
        if len(line) == q + 1 and len({(x - y) % v for x in line for y in line}) == v:
            return v, line
    raise ValueError(f"no cover of order {q}")


class Cover:
    """The cover for strings of ``width`` bytes: period, residues, and how many bytes a name has."""

    def __init__(self, width: int = WIDTH, order: int = ORDER):
        self.width = width
        self.v, self.residues = difference_cover(order)
        self.name = width - self.v + 1
        if self.name < 1:
            raise ValueError("the strings are shorter than the period of the cover")


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


_PACKED = ("names", "texts", "owners", "places")


def _thin(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as their low halves and then their high ones, which are mostly zeros."""
    return np.concatenate([x & 0xFFFF, x >> 16]).astype("<u2").tobytes()


def _full(blob: bytes) -> np.ndarray:
    halves = np.frombuffer(blob, "<u2").astype(np.int64)
    return halves[: len(halves) // 2] | halves[len(halves) // 2 :] << 16


def _pack(names: np.ndarray, uids: np.ndarray, at: np.ndarray) -> tuple[bytes, ...]:
    """48 bits of each name, the different texts, and by sample the number of its text and its place."""
    texts, owners = np.unique(uids, return_inverse=True)
    return names.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes(), texts.tobytes(), _thin(owners), _thin(at)


def _unpack(names: bytes, texts: bytes, owners: bytes, places: bytes) -> tuple[np.ndarray, ...]:
    thin = np.frombuffer(names, "<u2").reshape(-1, 3).astype(_U)
    return thin[:, 0] | thin[:, 1] << _U(16) | thin[:, 2] << _U(32), np.frombuffer(texts, np.int64)[_full(owners)], _full(places)


def _samples(cover: Cover, buckets: int):
    """Packed samples by bucket; what a block holds more than twice of one name goes by itself."""

    def run(batches):
        schema = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in _PACKED)])
        residues = np.array(cover.residues)
        for batch in flat.blocks(batches, "text", 1 << 21):
            data, offsets = flat.flat(batch.column("text"))
            size, uid = np.diff(offsets), batch.column("uid").to_numpy()
            at, owner = _places(residues, cover.v, np.where(size >= cover.width, size - cover.name, -1))
            if not len(at):
                continue
            begin = offsets[:-1][owner] + at
            names = flat.spans(flat.prefix(data), begin, begin + cover.name)
            order = np.lexsort((at % cover.v, names))
            names, at, uids = names[order], at[order], uid[owner[order]]
            third = np.zeros(len(names), bool)  # neither of least nor of greatest residue of its name here
            third[1:-1] = (names[1:-1] == names[:-2]) & (names[1:-1] == names[2:])
            bucket = np.where(third, -1, (flat.mix(names) % _U(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
            parts = [order[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(order)))]
            packed = [_pack(names[k], uids[k], at[k]) for k in parts]
            yield flat.rows(
                schema, bucket=bucket[order[cuts]], **{c: pa.array(x, pa.binary()) for c, x in zip(_PACKED, zip(*packed))}
            )

    return run


def _places(residues: np.ndarray, v: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled places 0..last of each text, and the text's number."""
    periods = np.maximum(last // v + 1, 0)
    owner = np.repeat(np.arange(len(last)), periods)
    begin = (np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods)) * v
    at = (begin[:, None] + residues).ravel()
    owner = np.repeat(owner, len(residues))
    keep = at <= last[owner]
    return at[keep], owner[keep]


def _shared(cover: Cover):
    """Of one bucket: the samples whose name others have too."""

    def run(key, table):
        rows = zip(*(table.column(c).to_pylist() for c in _PACKED))
        names, uids, places = (np.concatenate(x) for x in zip(*(_unpack(*row) for row in rows)))
        keep = np.ones(len(names), bool)
        if key[0].as_py() >= 0:
            order = np.argsort(names, kind="stable")
            names, uids, places = names[order], uids[order], places[order]
            start = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            size = np.diff(np.append(start, len(names)))
            residue = places % cover.v
            least, most = np.minimum.reduceat(residue, start), np.maximum.reduceat(residue, start)
            keep = np.repeat((size > 1) & ((least != most) | (least == cover.residues[0])), size)
        return pa.table({"uid": pa.array(uids[keep]), "place": pa.array(places[keep]), "name": pa.array(names[keep].view(np.int64))})

    return run


def _contexts(cover: Cover, batch, with_text: bool):
    """For every place in ``batch``: uid, place, name, first and last start of a string in the context, its hash or bytes."""
    data, offsets = flat.flat(batch.column("text"))
    lists = batch.column("places")
    owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
    struct = lists.flatten()
    place, name = (struct.field(c).to_numpy() for c in ("place", "name"))
    size = np.diff(offsets)[owner]
    low, high = np.maximum(place - cover.v + 1, 0), np.minimum(place + cover.width, size)
    out = {"uid": batch.column("uid").to_numpy()[owner], "place": place, "name": name, "low": low, "high": high - cover.width}
    begin = offsets[:-1][owner]
    if with_text:
        out["context"] = pa.array([data[a:b].tobytes() for a, b in zip(begin + low, begin + high)], pa.binary())
    else:
        lead = (place - low).astype(_U) * _U(0x9E3779B97F4A7C15)
        out["context"] = flat.mix(flat.spans(flat.prefix(data), begin + low, begin + high) ^ lead)
    return out


def _map_contexts(cover: Cover, with_text: bool):
    def run(batches):
        kinds = [(c, pa.int64()) for c in ("uid", "place", "name", "low", "high")]
        schema = pa.schema(kinds + [("context", pa.binary() if with_text else pa.int64())])
        for batch in flat.blocks(batches, "text", 1 << 20):
            yield flat.rows(schema, **_contexts(cover, batch, with_text))

    return run


def _strings(cover: Cover, data, offsets, lead):
    """Hash of the string at every distance before the sample, and where there is one: two tables by context, distance."""
    d = np.arange(cover.v)
    begin = lead[:, None] - d
    fits = (begin >= 0) & (begin + cover.width <= np.diff(offsets)[:, None])
    at = np.where(fits, begin + offsets[:-1][:, None], 0)
    end = np.where(fits, at + cover.width, 0)
    return flat.spans(flat.prefix(data), at.ravel(), end.ravel()).reshape(at.shape), fits


def _compared(cover: Cover):
    """Of one bucket of contexts: uid, first and last start of each run of repeated strings."""

    def run(key, table):
        data, offsets = flat.flat(table.column("context"))
        place, low, name, uid = (table.column(c).to_numpy() for c in ("place", "low", "name", "uid"))
        strings, fits = _strings(cover, data, offsets, place - low)
        k, d = np.nonzero(fits)
        of = flat.mix(name.view(_U))[k] + d.astype(_U) * _U(0xD1B54A32D192ED03)
        marks = flat.mix(strings[k, d] ^ flat.mix(of))
        order = np.argsort(marks)
        same = marks[order][1:] == marks[order][:-1]
        twice = np.zeros(len(marks), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        start = (place[k] - d)[twice]
        owner = k[twice]
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        new = np.ones(len(start), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1 if len(start) else first
        return pa.table(
            {"uid": pa.array(uid[owner[first]], pa.int64()), "low": pa.array(start[first], pa.int64()), "high": pa.array(start[last], pa.int64())}
        )

    return run


def _by_string(cover: Cover):
    """uid, start, name, distance and hash of every string in the contexts."""

    def run(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("uid", "start", "name", "distance", "string")])
        for batch in flat.blocks(batches, "context", 1 << 18):
            data, offsets = flat.flat(batch.column("context"))
            place, low, name, uid = (batch.column(c).to_numpy() for c in ("place", "low", "name", "uid"))
            strings, fits = _strings(cover, data, offsets, place - low)
            k, d = np.nonzero(fits)
            yield flat.rows(schema, uid=uid[k], start=place[k] - d, name=name[k], distance=d, string=strings[k, d])

    return run


def _cut(width: int):
    """Texts without the strings that start in the given ranges."""

    def run(batches):
        schema = pa.schema([("uid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        for batch in batches:
            got = {"uid": batch.column("uid"), "n_removed": [], "n_spans": [], "kept": []}
            for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                text = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                for low, high in sorted((r["low"], r["high"] + width) for r in ranges):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                at = 0
                kept = []
                for low, high in merged:
                    kept.append(text[at:low])
                    at = high
                kept.append(text[at:])
                got["n_removed"].append(sum(b - a for a, b in merged))
                got["n_spans"].append(len(merged))
                got["kept"].append(b"".join(kept))
            yield flat.rows(schema, **got)

    return run


def repeated_ranges(docs: DataFrame, cover: Cover, total: int, most_contexts: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """The texts that may hold repeated strings (uid, text, places), and (uid, low, high): the starts of such strings."""
    buckets = pieces(total, BUCKET_BYTES)
    packed = docs.mapInArrow(_samples(cover, buckets), "bucket long, " + ", ".join(f"{c} binary" for c in _PACKED))
    alone = F.when(F.col("bucket") < 0, F.xxhash64("names")).alias("alone")  # what needs no comparison is spread
    shared = saved(packed.groupBy("bucket", alone).applyInArrow(_shared(cover), "uid long, place long, name long"), "shared")
    released(docs.sparkSession)
    places = shared.distinct().groupBy("uid").agg(F.collect_list(F.struct("place", "name")).alias("places"))
    texts = saved(docs.join(places, "uid"), "texts")
    released(docs.sparkSession)

    kinds = "uid long, place long, name long, low long, high long, context "
    told = saved(texts.mapInArrow(_map_contexts(cover, False), kinds + "long"), "told")
    different = told.groupBy("name", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "place")).alias("one")
    )
    different = saved(different, "different")
    released(docs.sparkSession)
    again = different.filter("n > 1").select("name", "context")
    whole = told.join(again, ["name", "context"], "left_semi").filter("low <= high").select("uid", "low", "high")
    whole = saved(whole.groupBy("uid", "low", "high").count().drop("count"), "whole")
    released(docs.sparkSession)

    many = different.groupBy("name").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    ones = saved(different.join(many, "name").select("one.uid", "one.place", "name", "contexts"), "ones")
    count = ones.count()
    released(docs.sparkSession)
    wanted = ones.groupBy("uid").agg(F.collect_list(F.struct("place", "name", "contexts")).alias("places"))
    open_ = texts.select("uid", "text").dropDuplicates(["uid"]).join(wanted, "uid").mapInArrow(_map_contexts(cover, True), kinds + "binary")
    hot = ones.filter(F.col("contexts") > most_contexts).select("name").distinct()
    if hot.isEmpty():
        few, split = open_, None
    else:
        open_ = saved(open_, "contexts")
        few, split = open_.join(hot, "name", "left_anti"), open_.join(hot, "name", "left_semi")
    bucket = F.pmod(F.xxhash64("name"), F.lit(pieces(count, BUCKET_CONTEXTS))).alias("bucket")
    found = few.groupBy(bucket).applyInArrow(_compared(cover), "uid long, low long, high long")
    if split is not None:
        each = saved(split.mapInArrow(_by_string(cover), "uid long, start long, name long, distance long, string long"), "strings")
        twice = each.groupBy("name", "distance", "string").count().filter("count > 1").drop("count")
        starts = each.join(twice, ["name", "distance", "string"], "left_semi")
        found = found.unionByName(starts.select("uid", F.col("start").alias("low"), F.col("start").alias("high")))
    found = saved(found, "compared")
    released(docs.sparkSession)
    ranges = saved(whole.unionByName(found).distinct(), "ranges")
    released(docs.sparkSession)
    return texts, ranges


def without_repeats(docs: DataFrame, width: int = WIDTH, order: int = ORDER, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, and ``kept``, the bytes that are left."""
    cover = Cover(width, order)
    uid = F.xxhash64("doc_id", "text").alias("uid")
    named = docs.select("doc_id", uid, F.coalesce("text", F.lit("")).alias("text"))
    long_ones = named.filter(F.octet_length("text") >= width)
    total = long_ones.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts, ranges = repeated_ranges(long_ones.select("uid", "text"), cover, total, most_contexts)
    lists = ranges.groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    # Rows with one uid have one text, and so one result.
    cut = texts.select("uid", "text").dropDuplicates(["uid"]).join(lists, "uid")
    cut = cut.mapInArrow(_cut(width), "uid long, n_removed long, n_spans long, kept binary")
    cut = cut.withColumn("cut_sha256", F.sha2("kept", 256)).withColumnRenamed("kept", "left")
    rows = named.select("doc_id", "uid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all_sha256"), "text")
    return rows.join(cut, "uid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("cut_sha256", "all_sha256").alias("kept_sha256"),
        F.coalesce("left", F.col("text").cast("binary")).alias("kept"),
    )
