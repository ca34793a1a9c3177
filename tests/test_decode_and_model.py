import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from punctual.functions.vocabulary import Layout
from punctual.operators import decode, model

LAYOUT = Layout()
SKIP = LAYOUT.skip


def sequence(pairs, end=True, head=(31, 34, 150, 160)):
    out = list(head) + [x for pair in pairs for x in pair] + ([32] if end else [])
    return out + [33] * (75 - len(out))


def frame(spark, sequences):
    rows = [(f"v{i}", i, s) for i, s in enumerate(sequences)]
    return spark.createDataFrame(rows, "id string, seq bigint, tokens array<int>")


def test_decoding_sums_delta_steps(spark):
    tokens = sequence([(48, 15), (49, 17), (50, 14), (51, SKIP)], end=False)
    row = decode.decode_delays(frame(spark, [tokens]), SKIP).first()
    assert row.delay == [0, 2, 1, 1] and row.first_predicted_sequence == 3


def test_nothing_ahead_decodes_the_whole_row(spark):
    tokens = sequence([(48, 15), (49, 17), (50, 14), (51, 100)], end=False)
    row = decode.decode_delays(frame(spark, [tokens]), SKIP).first()
    assert row.first_predicted_sequence == 100 and len(row.delay) == 35 and row.delay[:5] == [0, 2, 1, 1, 1]


def test_first_predicted_is_two_after_the_highest(spark):
    for highest in range(4):
        pairs = [(48 + i, 15 if i <= highest + 1 else SKIP) for i in range(7)]
        row = decode.decode_delays(frame(spark, [sequence(pairs, end=False)]), SKIP).first()
        assert row.first_predicted_sequence == highest + 2


def test_messages(spark):
    messages = spark.createDataFrame([("v1:1,2,3",), ("v2",)], "message string")
    got = {r.id: r.tokens for r in decode.parse_messages(messages).collect()}
    assert got == {"v1": [1, 2, 3], "v2": None}


def test_prediction_json(spark):
    rows = spark.createDataFrame([("v", [0, 1], 4)], "id string, delay array<int>, first_predicted_sequence int")
    assert decode.prediction_json(rows).first().value == '{"id":"v","delay":[0,1],"first_predicted_sequence":4}'


def random_sequences(seed, count=40):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        start, n = rng.randrange(4), rng.randrange(3, 8)
        head = (31, 34 + rng.randrange(2), 150 + rng.randrange(7), 160 + rng.randrange(2))
        pairs = [(48 + start + i, 15 if i == 0 else rng.choice([13, 14, 15, 15, 15, 16])) for i in range(n)]
        out.append(sequence(pairs, head=head))
    return out


def contexts(tokens, place):
    before = tokens[place - 2] if place >= 2 else -1
    return [
        (),
        (tokens[place - 1],),
        (before, tokens[place - 1]),
        (tokens[1] if place > 1 else -1, tokens[3] if place > 3 else -1, before, tokens[place - 1]),
    ]


def counted(sequences):
    tables = [Counter() for _ in range(4)]
    for s in sequences:
        for place in range(1, len(s)):
            if s[place] != 33:
                for table, context in zip(tables, contexts(s, place)):
                    table[(context, s[place])] += 1
    return tables


def test_counts_loss_and_fill_equal_plain_python(spark):
    train, test = random_sequences(1), random_sequences(2, 10)
    tables = counted(train)
    fitted = model.count_tokens(frame(spark, train))
    assert sum(r.n for r in fitted[0].collect()) == sum(tables[0].values())
    got = {((r.route, r.hour, r.before, r.prev), r.next): r.n for r in fitted[3].collect()}
    assert got == dict(tables[3])

    losses = []
    for s in test:
        for place in range(1, len(s)):
            if s[place] == 33:
                continue
            p = (tables[0][((), s[place])] + 1) / (sum(tables[0].values()) + LAYOUT.size)
            for table, context in list(zip(tables, contexts(s, place)))[1:]:
                seen = [n for (c, _), n in table.items() if c == context]
                if seen:
                    p = (table[(context, s[place])] + len(seen) * p) / (sum(seen) + len(seen))
            losses.append(-math.log(p))
    row = model.cross_entropy(fitted, frame(spark, test), LAYOUT).first()
    assert row.targets == len(losses)
    assert row.loss == pytest.approx(sum(losses) / len(losses))
    assert row.loss < row.unigram_loss

    asked = []
    for s in test:
        known = 2 + s.index(32) // 4
        body = [SKIP if i % 2 == 1 and i >= 5 + 2 * (known - 2) and i < s.index(32) else t for i, t in enumerate(s)]
        body[s.index(32)] = 33
        asked.append(body)
    asked.append(sequence([(48, 15), (149, SKIP), (148, SKIP)], end=False))  # a stop never seen
    for s, row in zip(asked, model.fill_sequences(fitted, frame(spark, asked), LAYOUT).orderBy("seq").collect()):
        want = []
        for place, token in enumerate(s):
            if token == 33:
                break
            if token == SKIP:
                for table, context in reversed(list(zip(tables, contexts(want + [0], place)))):
                    seen = [(-n, x) for (c, x), n in table.items() if c == context]
                    if seen:
                        token = min(seen)[1]
                        break
            want.append(token)
        assert row.answer == want


def test_model_tables_are_stored_with_their_metrics(spark, tmp_path):
    train = frame(spark, random_sequences(3))
    fitted = model.count_tokens(train)
    loss = model.cross_entropy(fitted, train, LAYOUT)
    model.save_counts(fitted, loss, str(tmp_path))
    again = model.load_counts(spark, str(tmp_path))
    assert sorted(again[2].collect()) == sorted(fitted[2].collect())
    assert spark.read.parquet(f"{tmp_path}/metrics").first() == loss.first()


def test_error_metrics_and_largest_residuals(spark):
    rows = spark.createDataFrame([(1, 3.0, 1.0), (2, 0.0, 4.0), (3, 1.0, 1.0)], "k int, label double, prediction double")
    m = model.error_metrics(rows).first()
    assert (m.mse, m.mae, m.max_error) == (pytest.approx(20 / 3), 2.0, 4.0)
    assert (m.max_prediction, m.min_prediction, m.mean_prediction) == (4.0, 1.0, 2.0)
    assert [r.k for r in model.largest_residuals(rows, ["k"], k=2).collect()] == [1, 3]


def test_trees_fit_predict_and_store(spark, tmp_path):
    from punctual.operators.features import prefix_examples

    examples = prefix_examples(frame(spark, random_sequences(4)).withColumn("trip_id", F.col("id")))
    fitted = model.fit_tree(examples, rounds=2, depth=3)
    metrics = model.error_metrics(model.predict_tree(fitted, examples))
    mean = examples.agg(F.var_pop("label")).first()[0]
    assert metrics.first().mse < mean
    model.save_tree(fitted, metrics, str(tmp_path / "t"))
    assert (tmp_path / "t" / "model").exists() and (tmp_path / "t" / "metrics").exists()


def test_dataset_counts(spark):
    rows = frame(spark, random_sequences(5, 3)).withColumn("split", F.lit("train"))
    row = model.dataset_counts(rows).first()
    assert row.samples == 3 and row.longest <= 19


def test_messages_are_told_apart_without_parsing_them(spark):
    rows = [(None,), ("",), ("v",), ("v:",), ("v:1,2",), (":",), ("a:b:c",), ("v,1",)]
    messages = spark.createDataFrame(rows, "message string")
    parsed = decode.parse_messages(messages)
    for some, kind in ((decode.repeat_requests(messages), "tokens is null"), (decode.asked_sequences(messages), "tokens is not null")):
        want = parsed.filter(kind).collect()
        assert some.columns == parsed.columns and sorted(map(str, some.collect())) == sorted(map(str, want)) and len(want) == 4
