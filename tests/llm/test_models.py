import collections
import html
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from corpus import DOC_SCHEMA, WORD, crc, documents, lower

from punctual.llm import factorisation, page_difference, ppm, token_scan


def plain_scores(rows, order):
    tokens = [[w.encode() for w in WORD.findall(lower(t))] + [b"\n"] for _, t, *_ in rows]
    held = [crc(r[0], 7) == 2 for r in rows]
    count = collections.Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    trie = collections.defaultdict(collections.Counter)
    for w, times in count.items():
        s = b" " * order + w + b" "
        for k in range(order, len(s)):
            for o in range(order + 1):
                trie[s[k - o : k]][s[k]] += times

    def cost(w):
        s, total = b" " * order + w + b" ", 0.0
        for k in range(order, len(s)):
            gone = set()
            for o in range(order, -1, -1):
                left = {x: m for x, m in trie.get(s[k - o : k], {}).items() if x not in gone}
                if s[k] in left:
                    total += math.log10((2 * left[s[k]] - 1) / (2 * sum(left.values())))
                    break
                if left:
                    total += math.log10(len(left) / (2 * sum(left.values())))
                    gone |= set(left)
            else:
                total -= math.log10(256 - len(gone))
        return total

    costs = {w: cost(w) for ws in tokens for w in ws}
    return [
        (h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), sum(costs[w] for w in ws))
        for ws, h in zip(tokens, held)
    ]


@pytest.mark.parametrize("order", [2, 6])
def test_scores_are_those_of_a_plain_trie(spark, order):
    rows = documents(seed=6)
    got = sorted(ppm.score(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), order).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.score))
    want = sorted(zip((r[0] for r in rows), plain_scores(rows, order)), key=lambda x: (x[0] is None, x[0], x[1][-1]))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(i, *x[:4]) for i, x in want]
    assert np.allclose([r.base_score for r in got], [x[4] for _, x in want], rtol=1e-9)
    assert np.allclose([r.score for r in got], [x[5] for _, x in want], rtol=1e-6)  # costs travel as 32-bit numbers


def test_contexts_run_across_words(spark):
    rows, order = documents(seed=6)[:40], 4
    texts = [b" " * order + b" ".join([w.encode() for w in WORD.findall(lower(t))] + [b"\n"]) + b" " for _, t, *_ in rows]
    trie = collections.defaultdict(collections.Counter)
    for r, s in zip(rows, texts):
        for k in range(order, len(s) if crc(r[0], 7) != 2 else 0):
            for o in range(order + 1):
                trie[s[k - o : k]][s[k]] += 1

    def cost(s, k):
        gone, total = set(), 0.0
        for o in range(order, -1, -1):
            left = {x: m for x, m in trie.get(s[k - o : k], {}).items() if x not in gone}
            if s[k] in left:
                return total + math.log10((2 * left[s[k]] - 1) / (2 * sum(left.values())))
            total += math.log10(len(left) / (2 * sum(left.values()))) if left else 0
            gone |= set(left)
        return total - math.log10(256 - len(gone))

    got = ppm.score(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), order, by_word=False).collect()
    want = {r[0]: sum(cost(s, k) for k in range(order, len(s))) for r, s in zip(rows, texts)}
    assert len(got) == len(want) and all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-6) for r in got)


def test_the_query_learns_the_order_of_words(spark, tmp_path):
    from punctual.llm.queries import op9_ppm

    ids = [k for k in range(60) if crc(k, 7) != 2][:30] + [k for k in range(60, 160) if crc(k, 7) == 2][:2]
    texts = ["alpha beta gamma delta"] * 30 + ["alpha beta gamma delta", "delta beta alpha gamma"]
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in op9_ppm(spark, str(tmp_path)).collect()}
    assert got[ids[30]] > got[ids[31]] + 1


def test_probabilities_after_any_context_sum_to_one(spark):
    seen = {(97, 98): 3, (97, 99): 1, (98, 98): 2}
    rows = [(c << 8 | b, seen.get((c, b), 0)) for c in (97, 98, 120) for b in range(256)]
    got = ppm._costs(spark.createDataFrame(rows, "key long, n long"), 1).collect()
    total = collections.Counter()
    for r in got:
        total[r.key >> 8] += 10**r.cost
    assert len(got) == len(rows) and all(abs(x - 1) < 1e-9 for x in total.values())


def test_scores_of_few_and_no_texts(spark):
    assert ppm.score(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    held = next(k for k in range(100) if crc(k, 7) == 2)
    r, = ppm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0


def test_machine_equals_the_sum_over_pairs():
    m = factorisation.Machine(0.3)
    rng = np.random.default_rng(1)
    m.weights, m.factors = rng.normal(size=factorisation.SIZE), rng.normal(size=(factorisation.SIZE, factorisation.RANK))
    owner, place, value = np.array([0, 0, 0, 1]), np.array([5, 9, 20, 7]), np.array([0.5, -1.0, 2.0, 3.0])
    pairs = sum(m.factors[place[a]] @ m.factors[place[b]] * value[a] * value[b] for a in range(3) for b in range(a))
    want = [0.3 + m.weights[place[:3]] @ value[:3] + pairs, 0.3 + m.weights[7] * 3]
    assert np.allclose(m.parts(owner, place, value, 2)[0], want)


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        text = " ".join(word() + ("" if good else "##") for _ in range(rng.randint(10, 60)))
        rows.append((k, text, "en", f"s{k % 3}", len(text), None, None, None))
        labels.append((k, int(good), 0))
    frame = spark.createDataFrame(rows + documents()[:8], DOC_SCHEMA)
    known = spark.createDataFrame(labels + [(700, None, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = factorisation.classify(frame, known).collect()
    assert len(got) == 608 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id >= 8]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert {r.score for r in factorisation.classify(frame, known.limit(0)).collect()} == {0.5}
    assert factorisation.classify(frame.limit(0), known).collect() == []


def test_token_counts_over_block_ends(spark, tmp_path):
    rng, want = np.random.default_rng(0), {}
    for f in range(4):
        tokens = rng.integers(0, 6, 50 * f).astype("<u2")
        tokens[20:60] = 1
        (tmp_path / f"f{f}.bin").write_bytes(tokens.tobytes())
        ends = np.flatnonzero(tokens == 5)
        sizes = (np.diff(np.concatenate([[-1], ends])) - 1).tolist()
        rest = len(tokens) - (ends[-1] + 1 if len(ends) else 0)
        want |= {(f, k): int(n) for k, n in enumerate(sizes + ([rest] if rest else []))}
    for block, group in ((7, 3), (1, 2), (1000, 4)):
        blocks = token_scan.token_blocks(spark, str(tmp_path), "<u2", block)
        got = {(int(r.file[-5]), r.doc): r.n_tokens for r in token_scan.count_tokens(blocks, 5, "<u2", group).collect()}
        assert got == want


def test_token_counts_of_documents(spark):
    rows = documents()
    encoder = token_scan.tokeniser("/opt/tokenizers", "byte_bpe_50k.tiktoken")
    got = token_scan.document_lengths(spark.createDataFrame(rows, DOC_SCHEMA), "/opt/tokenizers", block=100).collect()
    want = collections.Counter((r[0], len(encoder.encode_ordinary(r[1] or ""))) for r in rows)
    assert want == collections.Counter((r.doc_id, r.n_tokens) for r in got)
    assert token_scan.document_lengths(spark.createDataFrame([], DOC_SCHEMA), "/opt/tokenizers").collect() == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for k, y in enumerate(b):
            row.append(old[k] + 1 if x == y else max(row[-1], old[k + 1]))
    return row[-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        for most in (1 << 28, 8):
            at = page_difference.common(a, b, most)
            rest = iter(b)
            assert len(at) == lcs(a, b) and at == sorted(set(at)) and all(any(x == y for y in rest) for x in (a[k] for k in at))


def extracted(spark, pages):
    frame = spark.createDataFrame([(k, u, h, "x") for k, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in page_difference.extract(frame).collect()}


def test_article_without_its_furniture(spark):
    page = (
        '<!DOCTYPE html><title>T</title><header>H</header><nav>menu</nav><div class="cookie-notice">ok?</div><article><header><h1>A &amp; b</h1></header>'
        '<p><b>One<br>two\n three<p>f<i>o</i>o &lt;x&gt; &am</p><script>var t="</p>";</script><form>mail</form><div id="comments"><p>bad</p></div>'
        "<aside>side</aside><p>end</article><footer>f</footer>"
    )
    pages = [("http://h/a", page), ("http://h/b", None), (None, ""), ("http://h/c", "<p>text <!-- cut"), ("http://h/d", "1 < 2 <b>x"), ("http://h/a", page)]
    got = extracted(spark, pages)
    assert got[0] == got[5] == "A & b One two three foo <x> &am end"
    assert got[1] == got[2] == "" and got[3] == "text" and got[4] == "1 < 2 x"


def test_open_pages_lose_what_the_nearest_page_has_too(spark):
    body = lambda *p: "".join(f"<div>{html.escape(x)}</div>" for x in p)
    pages = [
        ("http://h/x/1", body("Home", "first story", "Contact")), ("http://h/x/2", body("Home", "second story", "Contact")),
        ("http://other/x/2", body("Home", "alone", "Contact")), ("http://h/z", body("Index", "zed")), (None, body("Home")),
    ]
    got = extracted(spark, pages)
    assert got == {0: "first story", 1: "second story", 2: "Home alone Contact", 3: "Index zed", 4: "Home"}
    assert page_difference.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_the_nearest_page_decides_about_articles_too(spark):
    page = "<h2>{0} sub</h2><article><h1>Same</h1><div>Share this</div><p>shared text</p><p><a href=x>Next</a></p><p>story {0}</p></article><div>Home</div>"
    pages = [("http://h/a/1", page.format(1)), ("http://h/a/2", page.format(2)), ("http://h/b", "<article>Same<div>Same</div>only</article>")]
    pages += [("http://h/c", "<article>Same<div>Same</div>other</article>")]
    want = {k: f"{k + 1} sub Same shared text story {k + 1}" for k in (0, 1)} | {2: "Same Same only", 3: "Same Same other"}
    assert extracted(spark, pages) == want


def test_copies_are_not_each_others_furniture(spark):
    body = lambda *p: "".join(f"<div>{x}</div>" for x in p)
    pages = [("http://h/x/1", body("Home", "first"))] * 3 + [("http://h/x/2", body("Home", "first")), ("http://h/x/3", body("Home", "second"))]
    pages += [("http://copies/a", body("Home", "only")), ("http://copies/b", body("Home", "only"))]
    assert extracted(spark, pages) == dict.fromkeys(range(4), "first") | {4: "second"} | dict.fromkeys((5, 6), "Home only")


def test_one_host_over_many_partitions(spark):
    pages = [(f"http://h/{k:04}", f"<div>Menu</div><p>story {k}</p>") for k in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert extracted(spark, pages) == {k: f"story {k}" for k in range(200)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_vectors_take_every_column_kind():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([None, "", "a b a"]), "n_chars": pa.array([None, 3, 5], pa.int64())})
    owner, place, value = factorisation.vectors(batch)
    assert set(owner.tolist()) == {0, 1, 2} and np.isfinite(value).all() and place.max() < factorisation.SIZE
