"""The prefix trie of conversations that are rebuilt from the head of a base conversation and their own rest.

No rebuilt text is made. Every turn has a 128-bit key of its role and text, every run of turns a fingerprint in a monoid:
the sum of its terms times powers of a base, so fingerprints of runs compose by one multiplication and one addition, and
a run can be taken off at its front. One scan in the order of conversations and turns leaves at each turn the
fingerprint of its conversation up to there; the scan is cut anywhere, also inside a conversation, and what a task leaves
open is composed into the next. The first d turns of a rebuilt conversation have the fingerprint of the head, composed
with that of the own turns up to there without the first h. All conversations with the same (depth, fingerprint) are a
node.

Equality is verified: all members of a node must hold the same turn key at its depth and come from the same parent, and
turns of equal keys must have the same role and text, compared as such. Should any differ, all is done again with other
keys and bases, so the result is exact. A node keeps a reference (conversation, place) to its last turn instead of text.

Sums over subtrees need no walk. A node belongs to its smallest member, and a conversation's own nodes are the end of its
path. Each conversation sums its own nodes from every depth to its end; a node's subtree is the sum over its members at
its depth. The ids that end in a node are hashed as they stream by in order; where such a run crosses tasks, its text goes on in
pieces. SHA-256 is sequential, so the pieces of one node meet in one task, a few rows of text each.

Defined cases: rows without a conversation id belong to none and are left out; null turns come first, null roles and texts
are empty; turns of equal number follow their role, then their key, and repeated rows are turns of their own; base and
head may be absent or shorter; a conversation may be rebuilt to nothing and then ends in the root; ``%`` keeps the sign
of the id; an empty table gives no node; other columns are ignored. A conversation may hold any share of the rows: it
is cut into blocks of ``BLOCK`` depths. Heads hold at most ``longest_head`` turns, a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm import flat
from punctual.llm.tables import saved

#: Depths of one conversation that are summed in one group; salts that spread the children of one node.
BLOCK, SALTS = 1 << 16, 64
#: Bytes of the text of ids that one row carries on.
PIECE = 1 << 20

_U = np.uint64
_NODE = ["depth", "f1", "f2"]


def standard_base(conv_id: Column) -> Column:
    return conv_id - conv_id % 100


def standard_head(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def _keys(salt: int) -> tuple[Column, Column]:
    """Two 64-bit keys of a turn."""
    return tuple(F.xxhash64(F.lit(2 * salt + k), "role", "text") for k in range(2))


def _bases(salt: int) -> np.ndarray:
    return flat.mix(np.arange(1, 3, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt)) | _U(5)


def power(base: np.uint64, exponent: np.ndarray) -> np.ndarray:
    """``base`` (odd) to each exponent, modulo 2^64; a negative one is a power of the inverse."""
    out = np.ones(len(exponent), _U)
    for sign, square in ((1, int(base)), (-1, pow(int(base), -1, 1 << 64))):
        rest = np.where(sign * exponent > 0, sign * exponent, 0)
        while rest.any():
            out = np.where(rest & 1, out * _U(square), out)
            rest, square = rest >> 1, square * square % (1 << 64)
    return out


def _long(column) -> np.ndarray:
    return np.asarray(column.fill_null(0)).astype(np.int64, copy=False)


def _scan(bases: np.ndarray):
    """(task, conv_id, at, keys, chars, h1, h2): place and fingerprint of each turn in its conversation, from the task's first row on."""

    def run(batches):
        task = TaskContext.get().partitionId()
        open_, count, sums = None, 0, np.zeros(2, _U)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = _long(batch.column("conv_id"))
            first = np.concatenate([[True], conv[1:] != conv[:-1]])
            start = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            at = np.arange(n) - start[group]
            goes_on = open_ == conv[0]
            if goes_on:
                at += np.where(group == 0, count, 0)
            told = {}
            for k in range(2):
                terms = flat.mix(_long(batch.column(f"k{k + 1}")).view(_U)) * power(bases[k], at)
                whole = np.concatenate([np.zeros(1, _U), np.cumsum(terms, dtype=_U)])
                h = whole[1:] - whole[start][group]
                told[f"h{k + 1}"] = h + np.where(group == 0, sums[k], 0).astype(_U) if goes_on else h
            open_, count, sums = conv[-1], int(at[-1]) + 1, np.array([told["h1"][-1], told["h2"][-1]])
            arrays = [pa.array(np.full(n, task)), batch.column("conv_id"), pa.array(at), *(batch.column(c) for c in ("k1", "k2", "chars"))]
            arrays += [pa.array(told[c].view(np.int64)) for c in ("h1", "h2")]
            yield pa.RecordBatch.from_arrays(arrays, ["task", "conv_id", "at", "k1", "k2", "chars", "h1", "h2"])

    return run


def _composed(before: tuple[int, int, int], after: tuple[int, int, int], bases: np.ndarray) -> tuple[int, int, int]:
    """Number of turns and fingerprints of one run after another."""
    whole = [(b + a * pow(int(x), before[0], 1 << 64)) % (1 << 64) for b, a, x in zip(before[1:], after[1:], bases)]
    return (before[0] + after[0], *whole)


def _left_open(scan: DataFrame, bases: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """For each task that begins inside a conversation: the conversation, and what the tasks before hold of it. One row a task."""
    last = F.max_by(F.struct("conv_id", "at", "h1", "h2"), F.struct("conv_id", "at")).alias("last")
    tasks = scan.groupBy("task").agg(F.min(F.struct("conv_id", "at"))["conv_id"].alias("first"), last).orderBy("task").collect()
    out, conv, held = {}, None, (0, 0, 0)
    for t in tasks:
        end = (t["last"]["at"] + 1, t["last"]["h1"] % (1 << 64), t["last"]["h2"] % (1 << 64))
        if t["first"] == conv:
            out[t["task"]] = (conv, *held)
            if t["last"]["conv_id"] == conv:
                end = _composed(held, end, bases)
        conv, held = t["last"]["conv_id"], end
    return out


def _placed(open_: dict, bases: np.ndarray):
    """The scan with what was left open composed in."""

    def run(batches):
        for batch in batches:
            task, conv, at = (_long(batch.column(c)).copy() for c in ("task", "conv_id", "at"))
            h = [_long(batch.column(c)).view(_U).copy() for c in ("h1", "h2")]
            for t in np.unique(task).tolist():
                if t in open_:
                    of, count, *sums = open_[t]
                    inside = (task == t) & (conv == of)
                    for k in range(2):
                        h[k][inside] = h[k][inside] * _U(pow(int(bases[k]), count, 1 << 64)) + _U(sums[k])
                    at[inside] += count
            new = {"at": at, "h1": h[0].view(np.int64), "h2": h[1].view(np.int64)}
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def _joined_on(bases: np.ndarray):
    """Members from own turns after the head: the head's fingerprint composed with the own run without its first h turns."""

    def run(batches):
        for batch in batches:
            at, skip, held = (_long(batch.column(c)) for c in ("at", "h", "g"))
            depth = at - skip + held + 1
            told = {"depth": depth}
            for k in (1, 2):
                own = _long(batch.column(f"h{k}")).view(_U) - _long(batch.column(f"cut{k}")).view(_U)
                whole = _long(batch.column(f"g{k}")).view(_U) + own * power(bases[k - 1], held - skip)
                told[f"f{k}"] = whole.view(np.int64)
                term = flat.mix(_long(batch.column(f"k{k}")).view(_U)) * power(bases[k - 1], depth - 1)
                told[f"p{k}"] = (whole - term).view(np.int64)
            names = ["conv_id", "depth", "f1", "f2", "p1", "p2", "k1", "k2", "chars", "ref_conv", "ref_at", "ends"]
            same = {"ref_conv": "conv_id", "ref_at": "at"}
            yield pa.RecordBatch.from_arrays([pa.array(told[c]) if c in told else batch.column(same.get(c, c)) for c in names], names)

    return run


_MEMBER = "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, k1 long, k2 long, chars long, ref_conv long, ref_at long, ends boolean"


def _members(turns: DataFrame, salt: int, base: Callable, head: Callable, longest_head: int) -> DataFrame:
    """One row for each rebuilt conversation and depth: its node, the node's parent, and its last turn."""
    k1, k2 = _keys(salt)
    bases = _bases(salt)
    narrow = turns.select("conv_id", "turn", "role", k1.alias("k1"), k2.alias("k2"), F.length("text").cast("long").alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "k1", "k2"]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "role")
    scan = saved(ordered.mapInArrow(_scan(bases), "task long, conv_id long, at long, k1 long, k2 long, chars long, h1 long, h2 long"), "scan")
    open_ = _left_open(scan, bases)
    if open_:
        scan = scan.mapInArrow(_placed(open_, bases), scan.schema)

    conv = F.col("conv_id")
    scan = scan.withColumn("h", F.least(head(conv), F.lit(longest_head)))
    cut = F.max(F.when(F.col("at") == F.col("h") - 1, F.struct("h1", "h2"))).alias("cut")
    own = scan.groupBy("conv_id").agg(F.max("h").alias("h"), F.count("*").alias("n"), cut).withColumn("base", base(conv))
    entry = F.struct("at", "k1", "k2", "chars", F.col("h1").alias("f1"), F.col("h2").alias("f2"))
    heads = scan.filter((conv == base(conv)) & (F.col("at") < longest_head)).groupBy(conv.alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(entry)).alias("head"))
    made = own.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("h")))
    made = made.withColumn("g", F.size("head"))

    root = F.struct(*(F.lit(v).cast("long").alias(c) for c, v in {"at": -1, "k1": 0, "k2": 0, "chars": 0, "f1": 0, "f2": 0}.items()))
    path = made.withColumn("path", F.concat(F.array(root), "head"))
    path = path.select("conv_id", "base", "n", "h", "g", "path", F.posexplode("path").alias("depth", "one"))
    above = F.get("path", F.col("depth") - 1)
    in_head = path.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "one.f1", "one.f2", above["f1"].alias("p1"), above["f2"].alias("p2"),
        "one.k1", "one.k2", "one.chars", F.when(F.col("depth") > 0, F.col("base")).alias("ref_conv"),
        F.when(F.col("depth") > 0, F.col("one.at")).alias("ref_at"), ((F.col("depth") == F.col("g")) & (F.col("n") <= F.col("h"))).alias("ends"),
    )
    top = F.get("head", F.col("g") - 1)
    to_own = made.filter("n > h").select(
        "conv_id", "n", "g", top["f1"].alias("g1"), top["f2"].alias("g2"), F.col("cut.h1").alias("cut1"), F.col("cut.h2").alias("cut2")
    )
    rest = scan.filter("at >= h").join(to_own, "conv_id").withColumn("ends", F.col("at") == F.col("n") - 1)
    return saved(in_head.unionByName(rest.mapInArrow(_joined_on(bases), _MEMBER)), "members")


def _nodes(members: DataFrame) -> DataFrame:
    """One row a node; ``sure`` where all its members agree on its last turn and its parent."""
    alike = [F.min(c).eqNullSafe(F.max(c)) for c in ("p1", "p2", "k1", "k2", "chars")]
    sure = alike[0] & alike[1] & alike[2] & alike[3] & alike[4]
    return members.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"),
        F.max("p2").alias("p2"), F.min(F.struct("ref_conv", "ref_at")).alias("ref"), sure.alias("sure"),
    )


def _turns_agree(turns: DataFrame, salt: int) -> bool:
    """Whether turns of equal keys have the same role and text."""
    k1, k2 = _keys(salt)
    whole = F.struct("role", "text")
    same = turns.groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.min(whole).alias("least"), F.max(whole).alias("most"))
    return same.filter("least != most").isEmpty()


def _children(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children and the parent's conv_id. Children look their parent up by a salt, as one may have most of them."""
    counts = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    nodes = nodes.join(counts.agg(F.count("*").alias("n_children")), _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("up", F.col("depth") - 1).withColumn("salt", F.pmod("f1", F.lit(SALTS)))
    parents = nodes.select(F.col("depth").alias("up"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    asked = nodes.filter("depth > 0").select("up", "p1", "p2", "salt").distinct().join(parents, ["up", "p1", "p2"])
    return nodes.join(asked, ["up", "p1", "p2", "salt"], "left").drop("up", "salt")


def _sums(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) over subtrees."""
    worth = ((F.col("n_convs") - 1) * F.col("chars")).alias("worth")
    leaf = (F.col("n_children") == 0).cast("long").alias("leaf")
    none = F.lit(None).cast("long")
    rows = members.select("conv_id", "depth", "f1", "f2", F.lit(0).cast("long").alias("worth"), F.lit(0).cast("long").alias("leaf"))
    rows = rows.unionByName(nodes.select("conv_id", "depth", none.alias("f1"), none.alias("f2"), worth, leaf))
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    down = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumns({c: F.sum(c).over(down) for c in ("worth", "leaf")}).filter("f1 is not null")
    # Conversations of more than one block: what the deeper blocks hold.
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("worth").alias("more_worth"), F.sum("leaf").alias("more_leaf"))
    deeper = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    long = members.filter(F.col("depth") >= BLOCK).select("conv_id").distinct()
    if not long.isEmpty():
        blocks = blocks.join(long, "conv_id", "left_semi").withColumns({c: F.coalesce(F.sum(c).over(deeper), F.lit(0)) for c in ("more_worth", "more_leaf")})
        inside = inside.join(blocks, ["conv_id", "block"], "left")
        inside = inside.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("worth", "leaf")})
    return inside.groupBy(*_NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("worth").alias("saved_tokens"))


_ENDS = "depth long, f1 long, f2 long, task long, place long, piece binary, ends_sha256 string"


def _ends_here(batches):
    """The hash of the ids of every node that lies inside the task; the text of the first and the last one, in pieces."""
    schema = pa.schema([("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("task", pa.int64()), ("place", pa.int64())])
    schema = schema.append(pa.field("piece", pa.binary())).append(pa.field("ends_sha256", pa.string()))
    task, place = TaskContext.get().partitionId(), 0

    def put(nodes: list, pieces: list, hashes: list):
        nonlocal place
        places = np.arange(place, place + len(nodes))
        place += len(nodes)
        d, a, b = (np.array([x[k] for x in nodes], np.int64) for k in range(3))
        told = {"piece": pa.array(pieces, pa.binary()), "ends_sha256": pa.array(hashes, pa.string())}
        return flat.rows(schema, depth=d, f1=a, f2=b, task=np.full(len(nodes), task), place=places, **told)

    # A node goes in pieces if it may have begun before this task, may go on after it, or is long.
    node, parts, size, by_pieces = None, [], 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        d, a, b, conv = (_long(batch.column(c)) for c in (*_NODE, "conv_id"))
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])).tolist()
        nodes, hashes = [], []
        for at, to in zip(new, [*new[1:], batch.num_rows]):
            this = (int(d[at]), int(a[at]), int(b[at]))
            if this != node and node is not None:
                if not by_pieces:
                    nodes.append(node)
                    hashes.append(hashlib.sha256(b",".join(parts)).hexdigest())
                elif parts:
                    yield put([node], [b",".join(parts)], [None])
                parts, size, by_pieces = [], 0, False
            node = this
            parts.append(",".join(map(str, conv[at:to].tolist())).encode())
            size += len(parts[-1]) + 1
            if size >= PIECE:
                yield put([node], [b",".join(parts)], [None])
                parts, size, by_pieces = [], 0, True
        if nodes:
            yield put(nodes, [None] * len(nodes), hashes)
    if parts:
        yield put([node], [b",".join(parts)], [None])


def _ends_across(batches):
    """The hashes of nodes from their pieces in order."""
    node, told = None, None
    names = [*_NODE, "ends_sha256"]

    def put():
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([told.hexdigest()])], names)

    for batch in batches:
        for d, a, b, piece in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "piece"))):
            if (d, a, b) != node:
                if node is not None:
                    yield put()
                node, told = (d, a, b), hashlib.sha256(piece)
            else:
                told.update(b"," + piece)
    if node is not None:
        yield put()


def _ended(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes in which conversations end."""
    order = [*_NODE, "conv_id"]
    ends = members.filter("ends").select(*order)
    told = saved(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ends_here, _ENDS), "ends")
    open_ = told.filter("piece is not null").repartition(*_NODE).sortWithinPartitions(*_NODE, "task", "place")
    across = open_.select(*_NODE, "piece").mapInArrow(_ends_across, "depth long, f1 long, f2 long, ends_sha256 string")
    return told.filter("piece is null").select(*_NODE, "ends_sha256").unionByName(across)


def prefix_trie(
    conversations: DataFrame, base: Callable[[Column], Column] = standard_base, head: Callable[[Column], Column] = standard_head, longest_head: int = 5
) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, ref.

    ``base`` and ``head`` give for a conversation's id the conversation whose first turns it takes, and how many. ``ref`` is
    where the node's last turn stands in ``conversations``: a conversation and a place in it, from 0.
    """
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *empty)
    for salt in range(8):
        if not _turns_agree(turns, salt):
            continue
        members = _members(turns, salt, base, head, longest_head)
        nodes = saved(_nodes(members), "nodes")
        if nodes.filter("not sure").isEmpty():
            break
    else:
        raise RuntimeError("eight families of keys have met collisions")
    nodes = saved(_children(nodes), "nodes")
    out = nodes.join(_sums(members, nodes), _NODE).join(_ended(members), _NODE, "left")
    none = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "ref",
    )
