import collections

import pytest
from corpus import DOC_SCHEMA, WORD, documents

from punctual.llm import mixing, quality_rules


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {q for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for q in range(k, k + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_measures_and_verdicts(spark):
    rows = documents()
    got = quality_rules.judge(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    want = collections.Counter((r[0], *measures(r[1])) for r in rows)
    assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in got if not r.kept and not r.base_failed} <= {r.doc_id for r in got if r.n_symbols or r.n_upper > r.n_lower}


def test_host_rate_moves_the_verdict(spark):
    """The same failing document stays on a clean host and goes on a bad one; clean documents stay on both."""
    clean, odd = " ".join(f"word{k}" for k in range(80)), " ".join(f"word{k}#" for k in range(80))
    rows = [(k, clean, "good") for k in range(200)] + [(900, odd, "good")]
    rows += [(1000 + k, odd if k % 2 else clean, "bad") for k in range(200)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[900].kept and not got[1001].kept and got[1000].kept and got[0].kept
    assert 0 < got[0].host_rate < 0.1 < got[1000].host_rate < 0.6


@pytest.mark.parametrize("operator", [lambda d: quality_rules.judge(d), lambda d: mixing.mix(d)])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_targets_stop_at_three_times_the_source():
    goal = mixing.targets([("b", 100), ("a", 10), (None, 100), ("c", 90)])
    assert goal["a"] == 30 and goal["b"] == pytest.approx(270 * 2 / 8) and goal[None] == pytest.approx(270 * 5 / 8)
    assert sum(goal.values()) == pytest.approx(300)
    assert mixing.targets([("x", 0)]) == {"x": 0.0} and mixing.targets([]) == {}


def test_mix_meets_its_targets_and_repeats_itself(spark):
    rows = documents() + [(5000 + k, "w " * (1 + k % 37), "en", "s1", 1, None, None, None) for k in range(3000)]
    frame = spark.createDataFrame(rows, DOC_SCHEMA)
    got = mixing.mix(frame, block=64).collect()
    again = mixing.mix(frame.repartition(7), block=64).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows)
    sizes, taken, goal = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in got)
    assert sizes == collections.Counter({s: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in sizes})
    for s in sizes:  # a source of few documents, one of them with half of its words, can miss by part of that one
        largest = max(r.size for r in got if r.source == s)
        assert abs(taken[s] - goal[s]) <= (0.01 * goal[s] if len([r for r in got if r.source == s]) > 1000 else largest / 2), s


def test_flight_keeps_both_totals():
    size, p = [float(1 + (7 * k) % 50) for k in range(500)], [0.37] * 500
    words, number = sum(a * b for a, b in zip(size, p)), sum(p)
    mixing._move(size, p, iter([((k * 37) % 101) / 101 for k in range(600)]), 2)
    assert sum(1 for x in p if mixing.EPS < x < 1 - mixing.EPS) <= 2
    assert sum(a * b for a, b in zip(size, p)) == pytest.approx(words) and sum(p) == pytest.approx(number)


def test_a_plan_made_in_spark_is_the_same(spark):
    rows = documents() + [(7000 + k, "w " * (1 + k % 9), "en", f"source {k % 40}", 1, None, None, None) for k in range(400)]
    frame = spark.createDataFrame(rows, DOC_SCHEMA)
    plain = lambda most: sorted(map(str, mixing.mix(frame, block=64, most_sources=most).collect()))
    assert plain(3) == plain(1000)


def test_targets_of_many_sources(spark):
    """200,000 sources of very different sizes, null and empty ones among them; sources of few words fill up in several rounds."""
    sizes = [(None if k == 7 else "" if k == 9 else f"{k * 2654435761 % (1 << 32):x}", 0 if k % 11 == 0 else (k % 1000) ** 3 + 1) for k in range(200_000)]
    want = mixing.targets(sizes)
    per = spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, n long, rows long")
    got = {r.source: r.target for r in mixing.planned(per).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)
    assert sum(1 for s, n in sizes if n and want[s] == 3 * n) > 1000


def test_every_flight_against_a_literal_loop(spark):
    """Documents and words that the mix draws of a source, beside what their inclusion probabilities add up to."""
    rows = [(k, "w " * (1 + (k * 7919) % 60), "en", ("a", "b", "c")[k % 7 % 3], 1, None, None, None) for k in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOC_SCHEMA), block=128).collect()
    for source in ("a", "b", "c"):
        mine = [r for r in got if r.source == source]
        times = mine[0].target / mine[0].source_size
        assert abs(sum(r.taken // r.size for r in mine) - times * len(mine)) <= 2
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 60
        assert all(r.taken // r.size in (int(times), int(times) + 1) for r in mine)
