"""The trie of rebuilt conversations against one made of whole texts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from punctual.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, ref int, at long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, base=lambda c: c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), head=lambda c: zlib.crc32(str(c).encode()) % 6, order=None):
    convs = {}
    for r in rows:
        if r[0] is not None:
            convs.setdefault(r[0], []).append(((r[1] is not None, r[1] or 0, r[2] or ""), r[2] or "", r[3] or ""))
    convs = {c: [(role, text) for _, role, text in sorted(t, key=lambda x: x[0] + ((order or {}).get((x[1], x[2]), 0),))] for c, t in convs.items()}
    nodes = {}
    for c, own in convs.items():
        whole = tuple(convs.get(base(c), [])[: head(c)] + own[head(c) :])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], [[], []])[0].append(c)
        nodes[whole][1].append(c)
    out = {p: [min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), 0, 0, 0, ends] for p, (m, ends) in nodes.items()}
    for p in nodes:
        if p:
            out[p[:-1]][4] += 1
    for p, (m, _) in nodes.items():
        for d in range(len(p) + 1):
            out[p[:d]][5] += out[p][4] == 0
            out[p[:d]][6] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((*r[:7], hashlib.sha256(",".join(map(str, sorted(r[7]))).encode()).hexdigest()) for r in out.values() for r in [[x if x is not None else -(10**9) for x in r]])


def built(spark, rows, parts=3, **kw):
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts), **kw).select(*COLUMNS).collect()
    return sorted(tuple(x if x is not None else -(10**9) for x in r) for r in got)


def conversations(seed=0, n=260, words=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), 1000, 1001, -7, -100, -250, 5003]:
        shared = rng.random() < 0.5
        for t in range(rng.randint(1, 8)):
            text = rng.choice("abc"[:words]) * 3 if shared else f"{rng.random()}"
            rows.append((c, t, rng.choice(["user", "bot"]) if not shared else "user", text, "x", 1, 2))
    rows += [(2000 + k, t, "user", f"same {t}", "x", 1, 2) for k in range(150) for t in range(3)]  # a very common conversation
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, words", [(0, 3), (1, 1), (2, 2)])
def test_same_as_whole_texts(spark, seed, words):
    rows = conversations(seed, words=words)
    assert built(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(300, None, None, None, None, None, None), (300, 5, "user", "", "x", 1, 2), (300, -1, "user", "é漢", "x", 1, 2)]
    rows += [(None, 1, "user", "lost", "x", 1, 2), (None, None, None, None, None, None, None)]
    rows += [(301, 0, "a", "b", "x", 1, 2), (302, 0, "ab", "", "x", 1, 2), (303, 0, "", "ab", "x", 1, 2), (301, 1, "q" * 50_000, "r" * 50_000, "x", 1, 2)]
    rows += [(304, 2, "u", "t", "x", 1, 2)] * 3 + [(k, 0, "u", "only", "x", 1, 2) for k in range(400, 420)] + [(7**11, 1, "u", "t", "x", 1, 2)]
    assert built(spark, rows) == plain(rows)
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "a", "b", "x", 1, 2)]) == []


def test_ties_follow_role_and_key(spark):
    rows = [(k, 0, "u", t, "x", 1, 2) for k in (500, 501, 502) for t in "zyxw"] + [(500, 0, "a", "q", "x", 1, 2)]
    seen = spark.createDataFrame(rows, SCHEMA).select("role", "text", trie._keys(0)[0].alias("k")).distinct().collect()
    assert built(spark, rows) == plain(rows, order={(r["role"], r["text"]): r["k"] for r in seen})


def test_references_lead_to_the_last_turn(spark):
    rows = [r for r in conversations(4) if r[0] >= 0]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = trie.prefix_trie(frame).filter("depth > 0").collect()
    convs = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda r: r[:2]):
        convs.setdefault(c, []).append((role, text))
    for r in got:
        c, h = r["conv_id"], zlib.crc32(str(r["conv_id"]).encode()) % 6
        whole = convs.get(c - c % 100, [])[:h] + convs[c][h:]
        assert convs[r["ref"]["ref_conv"]][r["ref"]["ref_at"]] == whole[r["depth"] - 1]


def test_long_conversations_in_blocks_over_many_tasks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, "u", rng.choice("ab"), "x", 1, 2) for c in (100, 101, 700) for t in range(400)]
    rows += [(800 + c, t, "u", "ab"[c >> t & 1], "x", 1, 2) for c in range(16) for t in range(4)]
    monkeypatch.setattr(trie, "BLOCK", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert built(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_of_ids(spark, monkeypatch):
    rows = [(c, 0, "u", "x", "x", 1, 2) for c in range(3000)]
    monkeypatch.setattr(trie, "PIECE", 64)
    assert built(spark, rows) == plain(rows)


def test_collisions_are_found_and_mended(spark, monkeypatch):
    rows, keys, bases = conversations(7, 60), trie._keys, trie._bases
    with monkeypatch.context() as weak:  # texts by their length alone, at first
        weak.setattr(trie, "_keys", lambda salt: keys(salt) if salt else (F.length("text").cast("long"), F.lit(0).cast("long")))
        assert built(spark, rows) == plain(rows)
    with monkeypatch.context() as weak:  # sums without places, at first
        weak.setattr(trie, "_bases", lambda salt: bases(salt) if salt else bases(0) * 0 + bases(0).dtype.type(1))
        assert built(spark, rows) == plain(rows)


def test_other_heads(spark):
    rows = [r for r in conversations(8, 120) if r[0] >= 0]
    kw = {"base": lambda c: c - c % 10, "head": lambda c: (c % 4).cast("int")}
    assert built(spark, rows, longest_head=3, **kw) == plain(rows, base=lambda c: c - c % 10, head=lambda c: c % 4)
