import collections
import hashlib

import pytest
from corpus import DOC_SCHEMA, documents, shingles

from punctual.llm import components, minhash, suffixes


def linked(rows, percent, width=5):
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    named = collections.defaultdict(list)
    for k in range(len(rows)):
        named[find(k)].append(rows[k][0])
    out = []
    for k, r in enumerate(rows):
        ids = [i for i in named[find(k)] if i is not None] if sets[k] else [i for i in [r[0]] if i is not None]
        least = min(ids) if ids else None
        out.append((r[0], len(sets[k]), least, r[0] == least))
    return out


@pytest.mark.parametrize("percent,many", [(85, 64), (80, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, percent, many):
    monkeypatch.setattr(minhash, "MANY", many)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "TOGETHER", 2)
    rows = documents(seed=3)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA), percent).collect()
    assert collections.Counter(linked(rows, percent)) == collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)


def test_one_row_of_each_component_is_left(spark):
    rows = documents(seed=3)
    frame = spark.createDataFrame(rows, DOC_SCHEMA)
    left = minhash.one_of_each(frame, 80)
    assert left.columns == frame.columns
    kept = collections.Counter(r.doc_id for r in left.collect())
    want = {i for i, _, least, _ in linked(rows, 80) if i is not None and i == least}
    assert {i for i in kept if i is not None} == want and max(kept.values()) == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert minhash.near_duplicates(empty).collect() == [] and suffixes.without_repeats(empty).collect() == []


def test_estimate_is_close(spark):
    """Packed signatures of sets with known overlap."""
    words = [f"w{k}" for k in range(1000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:700] + [f"x{k}" for k in range(300)]))]
    signed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "1L as text_key", "doc_id as row", "text")
    signed = signed.mapInArrow(minhash._signatures(5), "doc_id long, text_key long, row long, n_shingles long, cls long, bands array<long>, bits array<long>")
    a, b = signed.filter("doc_id = 1").selectExpr("bits as a"), signed.filter("doc_id = 2").selectExpr("bits as b")
    got = a.join(b).select(minhash.similarity(a.a, b.b)).first()[0]
    exact = len(shingles(rows[0][1]) & shingles(rows[1][1])) / len(shingles(rows[0][1]) | shingles(rows[1][1]))
    assert abs(got - exact) < 0.18


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def without(rows, width):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for (doc_id, *_), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        left = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("width,order,most", [(400, 13, 10_000), (40, 5, 10_000), (40, 5, 1)])
def test_repeats_go_byte_by_byte(spark, width, order, most):
    rows = documents(seed=4)
    got = suffixes.without_repeats(spark.createDataFrame(rows, DOC_SCHEMA), width, order, most).collect()
    assert without(rows, width) == collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("q", [2, 3, 5, 7, 13])
def test_every_two_places_share_a_distance(q):
    v, line = suffixes.difference_cover(q)
    assert len(line) == q + 1
    assert {(x - y) % v for x in line for y in line} == set(range(v))
