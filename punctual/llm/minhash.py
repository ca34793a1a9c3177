"""Near-duplicates by b-bit MinHash.

Every text becomes the set of hashes of its word shingles. 120 minima of the set are taken; groups of four make 30 band
keys, and the low 4 bits of each minimum are kept, packed into eight longs. Texts with equal sets are one class from
then on, so copies never meet each other again.

Candidates: classes that share a band key. In each bucket the classes are compared with one of them, its centre. A
comparison first estimates the similarity from the packed bits, corrected for chance agreement, by counting bits; what
may reach the threshold is confirmed on the full sets. Confirmed links give components. Buckets that one component
fills, however large, are done. For classes in the other buckets, the shingles that no second class has are counted:
what two sets share cannot exceed what is left of either, which bounds their similarity exactly. The bucket's most
typical class, with the least share of such shingles, is the next centre, and once more there are components. What
still lies apart is compared in full: classes outside a bucket's largest component with all classes of other
components, as far as bound and estimate allow a link. No link of a bucket between components is left untested. In
buckets of more than ``MANY`` classes this runs in blocks of ``BLOCK`` classes on arrays, with a closer bound: shingles
are counted in 128 lanes by hash, and two sets cannot share more than the sum over the lanes of the lesser count.

Chances: a pair at similarity 0.85 shares no band with probability 2e-10, at 0.80 with 1e-7; the estimate is cut six
standard deviations below the threshold.

Defined cases: a text without words, or null, is linked with nothing; fewer words than a shingle make one shingle;
rows with a null id are linked, but never name a component unless all its ids are null; repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm import flat
from punctual.llm.components import components
from punctual.llm.tables import released, rows_of, saved, text_key

SHINGLE = 5
BANDS, ROWS, BITS = 30, 4, 4
MINIMA = BANDS * ROWS
PER_LONG = 15  # signatures: eight longs of fifteen 4-bit pieces
#: Members that meet a centre in one group of the exact check.
TOGETHER = 64

#: From this bucket size on, the last comparison runs on arrays, so many classes at a time.
MANY, BLOCK = 64, 1024
LANES = 128

_U = np.uint64
_A = flat.mix(np.arange(1, MINIMA + 1, dtype=_U)) | _U(1)
_X = flat.mix(np.arange(1001, MINIMA + 1001, dtype=_U))


def shingle_sets(column, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    data, offsets = flat.flat(column)
    n = len(offsets) - 1
    start, end, text = flat.words(flat.LOWER[data], offsets)
    word = flat.spans(flat.prefix(flat.LOWER[data]), start, end)
    del start, end
    n_words = np.bincount(text, minlength=n)
    begin = np.concatenate([[0], np.cumsum(n_words)])
    full = flat.windows(word, width)
    sets, bounds = [], np.zeros(n + 1, np.int64)
    for k in range(n):
        a, b = begin[k], begin[k + 1]
        if b - a >= width:
            one = np.sort(full[a : b - width + 1])
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        elif b > a:
            one = flat.windows(word[a:b], b - a)
        else:
            one = full[:0]
        sets.append(one)
        bounds[k + 1] = bounds[k] + len(one)
    return (np.concatenate(sets) if sets else full[:0]), bounds


def minima(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each of the permutations on every non-empty set: one row per permutation."""
    at = bounds[:-1][bounds[1:] > bounds[:-1]]
    out = np.full((MINIMA, len(at)), np.iinfo(np.uint64).max, _U)
    step = 1 << 15
    for a in range(0, len(shingles), step):
        b = min(a + step, len(shingles))
        lo, hi = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
        cuts = np.maximum(at[lo:hi] - a, 0)
        part = shingles[a:b]
        for k in range(MINIMA):
            got = np.minimum.reduceat((part ^ _X[k]) * _A[k], cuts)
            np.minimum(out[k, lo:hi], got, out=out[k, lo:hi])
    return out


def _signatures(width: int):
    def run(batches):
        schema = pa.schema(
            [("doc_id", pa.int64()), ("text_key", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64())]
            + [("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]
        )
        for batch in flat.blocks(batches, "text"):
            shingles, bounds = shingle_sets(batch.column("text"), width)
            size = np.diff(bounds)
            some = size > 0
            cls = classes(shingles, bounds)
            low = minima(shingles, bounds)
            m = low.shape[1]
            keys = np.zeros((BANDS, m), _U)
            for band in range(BANDS):
                h = np.full(m, band + 1, _U)
                for k in range(band * ROWS, band * ROWS + ROWS):
                    h = flat.mix(h ^ low[k])
                keys[band] = h
            kept = (low & _U((1 << BITS) - 1)).reshape(-1, PER_LONG, m)
            packed = np.zeros((kept.shape[0], m), _U)
            for k in range(kept.shape[1]):
                packed |= kept[:, k] << _U(BITS * k)

            def lists(rows):
                at = np.concatenate([[0], np.cumsum(np.where(some, rows.shape[0], 0))]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(rows.T).ravel().view(np.int64)))

            yield flat.rows(
                schema, doc_id=batch.column("doc_id"), text_key=batch.column("text_key"), row=batch.column("row"), n_shingles=size,
                cls=pa.array(cls.view(np.int64), mask=~some),
                bands=lists(keys), bits=lists(packed),
            )

    return run


def classes(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each set: equal sets have equal numbers."""
    out = np.zeros(len(bounds) - 1, _U)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        at = bounds[:-1][some]
        a = np.add.reduceat(flat.mix(shingles), at)
        b = np.bitwise_xor.reduceat(flat.mix(shingles + _U(77)), at)
        out[some] = flat.mix(a ^ flat.mix(b + np.diff(bounds)[some].astype(_U)))
    return out


def agreement(a: Column, b: Column) -> Column:
    """Minima whose kept bits agree, by counting bits of the packed signatures."""

    def differing(k: int) -> Column:
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    total = differing(0)
    for k in range(1, MINIMA // PER_LONG):
        total = total + differing(k)
    return F.lit(MINIMA) - total


def similarity(a: Column, b: Column) -> Column:
    """Estimated resemblance: the share of agreeing low bits, corrected for agreement by chance."""
    chance = 1.0 / (1 << BITS)
    return (agreement(a, b) / MINIMA - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    j, chance = percent / 100, 1.0 / (1 << BITS)
    seen = j + (1 - j) * chance
    return j - 6 * (seen * (1 - seen) / MINIMA) ** 0.5 / (1 - chance)


def _sets(width: int):
    def run(batches):
        schema = pa.schema([("centre", pa.int64()), ("part", pa.int64()), ("cls", pa.int64()), ("shingles", pa.binary())])
        given: set[tuple] = set()  # repeated rows give their set once
        for batch in flat.blocks(batches, "text", 1 << 20):
            shingles, bounds = shingle_sets(batch.column("text"), width)
            cls = classes(shingles, bounds).view(np.int64)
            right = (cls == batch.column("cls").to_numpy()) & (bounds[1:] > bounds[:-1])
            names = list(zip(batch.column("centre").to_pylist(), batch.column("part").to_pylist(), cls.tolist()))
            right = np.array([k for k in np.flatnonzero(right) if names[k] not in given and not given.add(names[k])], np.int64)
            yield flat.rows(
                schema, centre=batch.column("centre").take(right), part=batch.column("part").take(right), cls=cls[right],
                shingles=pa.array([shingles[bounds[k] : bounds[k + 1]].tobytes() for k in right], pa.binary()),
            )

    return run


def _confirm(percent: int):
    def run(key, table):
        cls = table.column("cls").to_numpy()
        centre = key[0].as_py()
        seen, links = {}, []
        for k, c in enumerate(cls.tolist()):
            seen.setdefault(c, k)
        blobs = table.column("shingles")
        own = np.frombuffer(blobs[seen[centre]].as_py(), _U) if centre in seen else None
        for c, k in seen.items():
            if own is None or c == centre:
                continue
            other = np.frombuffer(blobs[k].as_py(), _U)
            small, large = (own, other) if len(own) < len(other) else (other, own)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            if 100 * both >= percent * (len(own) + len(other) - both):
                links.append(c)
        return pa.table({"a": pa.array([centre] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})

    return run


def confirmed(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the (centre, member) pairs of classes, those whose full sets reach the threshold, as (a, b)."""
    groups = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).select(
        "centre", F.ceil(F.col("n") / TOGETHER).cast("long").alias("parts")
    )
    members = pairs.join(groups, "centre").select(
        "centre", F.pmod(F.xxhash64("member"), "parts").alias("part"), F.col("member").alias("cls")
    )
    centres = groups.select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("cls")
    )
    return (
        texts.join(members.unionByName(centres), "cls")
        .select("text", "centre", "part", "cls")
        .mapInArrow(_sets(width), "centre long, part long, cls long, shingles binary")
        .groupBy("centre", "part")
        .applyInArrow(_confirm(percent), "a long, b long")
    )


def _each_shingle(width: int):
    def run(batches):
        schema = pa.schema([("shingle", pa.int64()), ("cls", pa.int64())])
        for batch in flat.blocks(batches, "text", 1 << 20):
            shingles, bounds = shingle_sets(batch.column("text"), width)
            cls = classes(shingles, bounds).view(np.int64)
            right = np.repeat(cls == batch.column("cls").to_numpy(), np.diff(bounds))
            yield flat.rows(schema, shingle=shingles[right], cls=np.repeat(cls, np.diff(bounds))[right])

    return run


def _own_shingles(texts: DataFrame, among: DataFrame, width: int) -> DataFrame:
    """(cls, own): of each class in ``among``, the shingles that no other class in ``among`` has."""
    each = texts.join(among, "cls", "left_semi").select("cls", "text").mapInArrow(_each_shingle(width), "shingle long, cls long")
    holders = each.groupBy("shingle").agg(F.min("cls").alias("cls"), F.max("cls").alias("other"))
    return holders.filter("cls = other").groupBy("cls").agg(F.count(F.lit(1)).alias("own"))


def _lanes(width: int):
    def run(batches):
        schema = pa.schema([("cls", pa.int64()), ("lanes", pa.binary())])
        for batch in flat.blocks(batches, "text", 1 << 20):
            shingles, bounds = shingle_sets(batch.column("text"), width)
            right = np.flatnonzero(classes(shingles, bounds).view(np.int64) == batch.column("cls").to_numpy())
            lane = (flat.mix(shingles) % _U(LANES)).astype(np.int64)
            counts = [np.bincount(lane[bounds[k] : bounds[k + 1]], minlength=LANES).astype(np.uint32) for k in right]
            yield flat.rows(
                schema, cls=batch.column("cls").take(pa.array(right)), lanes=pa.array([c.tobytes() for c in counts], pa.binary())
            )

    return run


def _meet(percent: int):
    """Of one block of a bucket: the pairs of outsiders and members of other components that may be linked."""

    def run(key, table):
        cls, part, most, n = (table.column(c).to_numpy() for c in ("cls", "component", "largest", "n"))
        bits = np.array(table.column("bits").to_pylist(), np.int64).view(_U)
        lanes = np.array([np.frombuffer(b, np.uint32) for b in table.column("lanes").to_pylist()])
        out = table.column("out").to_numpy(zero_copy_only=False)
        ask, there = np.flatnonzero(out), np.flatnonzero(~out)
        chance, low = 1.0 / (1 << BITS), _U(0x1111111111111111)
        ones, twos = [], []
        for x in ask:
            y = there[(part[there] != part[x]) & ((part[there] == most[x]) | (cls[x] < cls[there]))]
            d = bits[y] ^ bits[x]
            d |= d >> _U(1)
            d |= d >> _U(2)
            seen = 1 - np.bitwise_count(d & low).sum(1) / MINIMA
            y = y[(seen - chance) / (1 - chance) >= least_estimate(percent)]
            both = np.minimum(lanes[y], lanes[x]).sum(1, dtype=np.int64)
            y = y[100 * both >= percent * (n[x] + n[y] - both)]
            ones.append(np.full(len(y), cls[x]))
            twos.append(cls[y])
        one, two = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (ones, twos))
        return pa.table({"centre": pa.array(one, pa.int64()), "member": pa.array(two, pa.int64())})

    return run


def _met_in_blocks(texts: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """(centre, member): what may be linked across the components of large buckets."""
    wanted = texts.join(placed.select("cls").distinct(), "cls", "left_semi").select("cls", "text")
    lanes = wanted.mapInArrow(_lanes(width), "cls long, lanes binary")
    rows = placed.join(lanes, "cls").select("key", "cls", "component", "largest", "of.n", "of.bits", "lanes", "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    members = rows.select("*", F.pmod(F.xxhash64("cls"), blocks).alias("block"), F.lit(False).alias("out"))
    outside = rows.filter("component != largest").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("out")
    )
    return members.unionByName(outside).groupBy("key", "block").applyInArrow(_meet(percent), "centre long, member long")


def _apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """key, cls, component, largest, size: the buckets whose classes lie in different components."""
    placed = shared.select("key", "cls").join(found, "cls", "left")
    placed = placed.withColumn("component", F.coalesce("component", "cls"))
    by_part = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_part.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size")
    )
    mixed = mixed.filter("parts > 1").select("key", F.col("most.component").alias("largest"), "size")
    return placed.join(mixed, "key")


def _linkable(percent: int) -> Column:
    """Whether estimate and bound leave a link between ``one`` and ``two`` (n, own, bits) within reach."""
    one, two = F.col("one"), F.col("two")
    most = F.least(one["n"] - one["own"], two["n"] - two["own"])
    within = 100 * most >= percent * (one["n"] + two["n"] - most)
    return within & (similarity(one["bits"], two["bits"]) >= least_estimate(percent))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, part.

    ``component_id`` is the least id reachable over links of ``percent`` or more, and ``kept`` tells whether it is the
    row's own. ``part`` numbers the component whatever its ids are, and is null for a text without words.
    """
    narrow = docs.select("doc_id", text_key(), _row(), "text")
    signed = narrow.mapInArrow(
        _signatures(width), "doc_id long, text_key long, row long, n_shingles long, cls long, bands array<long>, bits array<long>"
    )
    signed = saved(signed, "signatures")
    reps = saved(
        signed.filter("cls is not null").groupBy("cls").agg(
            F.min("doc_id").alias("label"), F.min("row").alias("row"),
            F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n"),
        ),
        "classes",
    )
    keyed = reps.select(F.explode("bands").alias("key"), "cls")
    buckets = keyed.groupBy("key").agg(F.min("cls").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = saved(keyed.join(buckets.select("key", "centre"), "key"), "buckets")
    released(docs.sparkSession)
    candidates = reps.select("cls", "row").join(shared.select("cls").distinct(), "cls", "left_semi")
    texts = saved(narrow.select("row", "text").join(candidates, "row").select("cls", "text"), "texts")
    released(docs.sparkSession)

    stars = shared.filter("cls != centre").select("centre", F.col("cls").alias("member")).distinct()
    links = saved(confirmed(texts, saved(_likely(stars, reps, percent), "likely"), width, percent), "links")
    released(docs.sparkSession)

    apart = saved(_apart(shared, saved(components(links, "cls", "component"), "found")), "apart")
    among = apart.select("cls").distinct()
    known = reps.join(among, "cls", "left_semi").join(_own_shingles(texts, among, width), "cls", "left")
    known = known.select("cls", F.struct("n", F.coalesce("own", F.lit(0)).alias("own"), "bits").alias("of"))
    known = saved(known, "known")
    released(docs.sparkSession)

    placed = apart.join(known, "cls")
    typical = F.min(F.struct(F.col("of.own") / F.col("of.n"), "cls")).alias("typical")
    centre = placed.groupBy("key").agg(typical).select("key", F.col("typical.cls").alias("centre"))
    centre = centre.join(placed.select("key", F.col("cls").alias("centre"), F.col("component").alias("with"), F.col("of").alias("one")), ["key", "centre"])
    second = placed.withColumnRenamed("of", "two").join(centre, "key").filter(F.col("component") != F.col("with"))
    second = second.filter(_linkable(percent)).select("centre", F.col("cls").alias("member")).distinct()
    links = saved(links.unionByName(confirmed(texts, saved(second, "second"), width, percent)), "links")
    released(docs.sparkSession)

    placed = saved(_apart(shared, saved(components(links, "cls", "component"), "found")).join(known, "cls"), "placed")
    large = placed.filter(F.col("size") > MANY)
    few = placed.filter(F.col("size") <= MANY)
    outside = few.filter("component != largest").withColumnRenamed("of", "one")
    others = few.select(
        F.col("key").alias("same"), F.col("cls").alias("member"), F.col("component").alias("with"), F.col("of").alias("two")
    )
    # A pair of two outsiders comes up twice in a bucket; it is taken once.
    once = (F.col("with") == F.col("largest")) | (F.col("cls") < F.col("member"))
    rest = outside.join(
        others, (F.col("key") == F.col("same")) & (F.col("component") != F.col("with")) & once & _linkable(percent)
    )
    rest = rest.select(F.col("cls").alias("centre"), "member")
    rest = rest.unionByName(_met_in_blocks(texts, large, width, percent)).distinct()
    links = saved(links.unionByName(confirmed(texts, saved(rest, "rest"), width, percent)), "links")
    released(docs.sparkSession)

    found = components(links, "cls", "component")
    named = reps.select("cls", "label").join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("label").alias("component_id"))
    named = named.join(least, "component").select("cls", "component_id", F.col("component").alias("part"))
    out = signed.select("doc_id", "text_key", "n_shingles", "cls").join(named, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), kept.alias("kept"), "part")


def one_of_each(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component left: the one of the least id. Rows without words stay, once each."""
    judged = saved(near_duplicates(docs, percent, width), "judged")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    first = judged.filter("part is not null").groupBy("part").agg(F.min(key).alias("first")).select("first.*")
    stay = first.select("doc_id", "text_key").unionByName(judged.filter("part is null").select("doc_id", "text_key"))
    left = rows_of(docs, stay)
    if judged.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        return left
    return left.withColumn("_text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")


def _row() -> Column:
    """What finds a row again: its id or, for want of one, a hash of its text."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("row")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose packed signatures leave the threshold within reach."""
    a = reps.select(F.col("cls").alias("centre"), F.col("bits").alias("bits_a"))
    b = reps.select(F.col("cls").alias("member"), F.col("bits").alias("bits_b"))
    both = pairs.join(a, "centre").join(b, "member")
    return both.filter(similarity(F.col("bits_a"), F.col("bits_b")) >= least_estimate(percent)).select("centre", "member")
