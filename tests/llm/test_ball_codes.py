"""Codes by ball k-means against a plain search over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from punctual.llm import ball_codes

SCHEMA = "vec_id long, embedding array<float>, label int, part string, code string"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """(vec_id, code, error, label_error) of every kept row as a list, and the codebooks, by the rules and nothing else."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = next((len(v) for _, v, _ in order if v and len(v) % parts == 0), None)
    fit = [r for r in order if len(r[1]) == length]
    width = (length or 0) // parts
    books = [[r[1][p * width : (p + 1) * width] for r in fit[:entries]] for p in range(parts)] if fit else []

    def assign(v):
        out = []
        for p, book in enumerate(books):
            x = v[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)))
        return out

    for _ in range(rounds):
        got = [assign(v) for _, v, _ in fit]
        for p, book in enumerate(books):
            for k in range(len(book)):
                own = [r[1][p * width : (p + 1) * width] for r, g in zip(fit, got) if g[p][1] == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own)]
    told = [(i, lab, *(("".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a)) if (a := len(v) == length and assign(v)) else (None, None))) for i, v, lab in kept]
    totals = {}
    for _, lab, _, error in told:
        if error is not None:
            totals[lab] = totals.get(lab, 0) + error
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [(i, code, error, totals.get(lab)) for i, lab, code, error in told], hashlib.sha256(text.encode()).hexdigest()


def coded(spark, rows, schema=SCHEMA, **kw):
    told, books = ball_codes.codes(spark.createDataFrame(rows, schema).repartition(3), **kw)
    told = ball_codes.with_label_errors(told.select("vec_id", "label", ball_codes.code_text().alias("code"), "error"))
    return [tuple(r) for r in told.select("vec_id", "code", "error", "label_error").collect()], ball_codes.books_digest(books)


def key(row):
    return tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in row)


def table(n, width=4, seed=0, spread=1.0):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, spread) for _ in range(16 * width)], rng.choice([None, 1, 2, 3]), "p", "c") for k in range(n)]


@pytest.mark.parametrize("n, width, spread", [(400, 4, 0.2), (150, 1, 0.01), (40, 2, 1.0), (700, 2, 30.0)])
def test_same_as_comparing_all(spark, n, width, spread):
    rows = table(n, width, n, spread)
    rows += [(n + k, rows[3][1], 1, "p", "c") for k in range(200)]  # a very common vector
    got, digest = coded(spark, rows)
    want, whole = plain(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and digest == whole


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = table(80, 2, 5)
    rows += [(5, [0.5] * 32, None, None, None), (5, [0.5] * 32, None, None, None), (None, [0.25] * 32, 7, "p", "c"), (-4, [-0.001] * 32, 7, "p", "c")]
    rows += [(900, None, 1, "p", "c"), (901, [nan] + [0.0] * 31, 1, "p", "c"), (902, [inf] + [0.0] * 31, 1, "p", "c"), (903, [None] + [0.0] * 31, 1, "p", "c")]
    rows += [(904, [1.0] * 5, 9, "p", "c"), (905, [], 2, "p", "c"), (906, [1.0] * 48, None, "p", "c")]
    got, digest = coded(spark, rows)
    want, whole = plain(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and digest == whole
    assert not {900, 901, 902, 903} & {r[0] for r in got} and {904, 905, 906} <= {r[0] for r in got}


def test_empty_tables_and_tables_without_vectors(spark):
    for rows in ([], [(1, None, 2, "p", "c")], [(1, [], None, "p", "c"), (2, [1.0], 1, "p", "c")]):
        got, digest = coded(spark, rows)
        assert sorted(got, key=key) == sorted(plain(rows)[0], key=key)
        assert digest == hashlib.sha256(b"").hexdigest()


def test_other_numbers_of_parts_entries_and_rounds(spark):
    rows = table(120, 3, 8)
    for kw in ({"parts": 4, "entries": 7, "rounds": 3}, {"parts": 48, "entries": 256, "rounds": 0}, {"parts": 1, "entries": 1, "rounds": 1}):
        got, digest = coded(spark, rows, **kw)
        want, whole = plain(rows, **kw)
        assert sorted(got, key=key) == sorted(want, key=key) and digest == whole


def test_doubles_and_text_labels_and_numbers_too_large(spark):
    rows = [(k, [k * 0.37 + 0.01 * j for j in range(16)], "ab"[k % 2]) for k in range(90)]
    schema = "vec_id long, embedding array<double>, label string"
    got, _ = coded(spark, rows, schema)
    assert len(got) == 90 and len({r[3] for r in got}) == 2
    with pytest.raises(Exception, match="64 bits"):
        coded(spark, [(1, [1e30] * 16, "a"), (2, [1.0] * 16, "a")], schema)


def test_balls_leave_out_only_what_is_farther():
    rng = np.random.default_rng(1)
    for width, top in ((1, 9), (4, 40), (4, 4000)):
        entries, x = rng.integers(-top, top, (64, width)), rng.integers(-top, top, (3000, width))
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        for owner in (np.zeros(3000, np.int64), rng.integers(0, 64, 3000), far.argmin(1)):
            best, least = ball_codes.Balls(entries).assign(x, owner)
            assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
