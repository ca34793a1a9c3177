"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words hashed to 2^14 places (root of the frequency, scaled to length one), statistics
of its structure as numbers and as ten steps each, and its stated length. Every pair of places has a weight, the
product of two vectors of rank 8; the sum over all pairs takes linear time, as half the difference of the square of
the sum and the sum of the squares.

The fit takes at most ``MOST_TRAINING`` labelled documents, those with the least hash of their id. Shards of them are
fitted by stochastic gradients side by side, and the models averaged, round by round; a model has a fixed size (below
1 MB), which is all that passes through the driver. Scoring reads every whole text once.

Defined cases: a null or empty text has no words and is scored by its statistics; a null n_chars counts as the length
of the text; labels that are null, contradictory or of a null id are left out; with labels of one kind only, or none,
every score is that share (0.5 without any); repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import flat
from punctual.llm.tables import crc_mod, saved

MOST_TRAINING = 20_000
FOLDS = 5
THRESHOLD = 0.3
PLACES, RANK, STEPS = 1 << 14, 8, 10
SHARDS, ROUNDS, EPOCHS, BATCH, RATE, DECAY = 4, 6, 3, 128, 0.08, 1e-5
STATISTICS = (
    "words length stated symbols upper digits marks distinct neighbours again width bars shouts foreign lines".split()
)
SIZE = PLACES + len(STATISTICS) * (1 + STEPS)

_U = np.uint64


def vectors(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of a batch (text, n_chars): text number (ascending), place, value."""
    n = batch.num_rows
    data, offsets = flat.flat(batch.column("text"))
    size = np.diff(offsets)
    start, end, text = flat.words(data, offsets)
    word = flat.spans(flat.prefix(flat.LOWER[data]), start, end)
    n_words = np.bincount(text, minlength=n)

    key, count = np.unique(text * PLACES + (word >> _U(50)).astype(np.int64), return_counts=True)
    owner = key // PLACES
    value = np.sqrt(count / np.maximum(n_words[owner], 1))

    def share(marks: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)

    def any_of(chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return table[data]

    letters = (data >= 65) & (data <= 90)
    small = (data >= 97) & (data <= 122)
    alphabetic = share(letters | small, np.ones(n)) if len(data) else np.zeros(n)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    far = np.unique(flat.mix(word) ^ flat.mix(text.astype(_U) + _U(1)), return_index=True)[1]
    a, b, line_of = flat.runs(data != 10, offsets)
    lines = np.bincount(line_of, minlength=n)
    line = flat.spans(flat.prefix(data), a, b)
    first = np.unique(flat.mix(line) ^ flat.mix(line_of.astype(_U) + _U(1)), return_index=True)[1]
    stated = batch.column("n_chars").to_pandas().fillna(-1).to_numpy().astype(float)
    stated = np.where(stated < 0, size, stated)
    by_word = np.maximum(n_words, 1)
    got = {
        "words": np.log1p(n_words) / 12,
        "length": np.log1p(size) / 14,
        "stated": np.log1p(np.maximum(stated, 0)) / 14,
        "symbols": share(any_of(b"#*$%&<>"), n_words * 2),
        "upper": share(letters, alphabetic),
        "digits": share((data >= 48) & (data <= 57), size) * 4,
        "marks": share(any_of(b".,;:?"), n_words),
        "distinct": np.bincount(text[far], minlength=n) / by_word,
        "neighbours": np.bincount(text[same], minlength=n) / by_word,
        "again": 1 - np.bincount(line_of[first], minlength=n) / np.maximum(lines, 1),
        "width": (np.bincount(text, end - start, n) / by_word) / 20,
        "bars": share(any_of(b"|"), n_words),
        "shouts": share(any_of(b"!"), n_words * 2),
        "foreign": share(data >= 128, size) * 2,
        "lines": np.log1p(lines / by_word * 20) / 4,
    }
    owners, places, values = [owner], [key % PLACES], [value]
    for k, name in enumerate(STATISTICS):
        x = np.clip(np.nan_to_num(got[name]), 0, 1)
        at = PLACES + k * (1 + STEPS)
        owners += [np.arange(n), np.arange(n)]
        places += [np.full(n, at), at + 1 + np.minimum((x * STEPS).astype(np.int64), STEPS - 1)]
        values += [x, np.full(n, 0.5)]
    owner, place, value = (np.concatenate(z) for z in (owners, places, values))
    order = np.argsort(owner, kind="stable")
    return owner[order], place[order], value[order]


class Machine:
    """Bias, weights and rank-``RANK`` vectors of all places, with the sums of squared gradients that scale their steps."""

    def __init__(self, bias: float = 0.0):
        rng = np.random.default_rng(7)
        self.bias = bias
        self.weights, self.past = np.zeros(SIZE), np.full(SIZE, 1e-2)
        self.factors, self.past_factors = rng.normal(0, 0.02, (SIZE, RANK)), np.full((SIZE, RANK), 1e-2)

    @staticmethod
    def mean(machines: list[Machine]) -> Machine:
        out = Machine()
        for name in vars(out):
            setattr(out, name, sum(getattr(m, name) for m in machines) / len(machines))
        return out

    def parts(self, owner, place, value, n: int):
        """Linear sum and, for each factor, the sum over a document's places."""
        vx = self.factors[place] * value[:, None]
        sums = np.stack([np.bincount(owner, vx[:, f], n) for f in range(RANK)], 1)
        squares = np.bincount(owner, (vx * vx).sum(1), n)
        linear = np.bincount(owner, self.weights[place] * value, n)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums, vx

    def scores(self, owner, place, value, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(owner, place, value, n)[0], -30, 30)))

    def learn(self, owner, place, value, label: np.ndarray) -> None:
        n = len(label)
        raw, sums, vx = self.parts(owner, place, value, n)
        off = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label
        pull = off[owner] * value
        touched, at = np.unique(place, return_inverse=True)
        g = np.bincount(at, pull, len(touched)) / n + DECAY * self.weights[touched]
        slope = pull[:, None] * (sums[owner] - vx)
        gf = np.stack([np.bincount(at, slope[:, f], len(touched)) for f in range(RANK)], 1) / n + DECAY * self.factors[touched]
        self.past[touched] += g * g
        self.past_factors[touched] += gf * gf
        self.weights[touched] -= RATE * g / np.sqrt(self.past[touched])
        self.factors[touched] -= RATE * gf / np.sqrt(self.past_factors[touched])
        self.bias -= RATE * off.mean()


def _examples(batches):
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("label", pa.float64()), ("places", pa.binary()), ("values", pa.binary())])
    for batch in flat.blocks(batches, "text"):
        owner, place, value = vectors(batch)
        cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
        yield flat.rows(
            schema, shard=batch.column("shard"), place=batch.column("place"), label=batch.column("label").cast(pa.float64()),
            places=cut(place.astype(np.int32)), values=cut(value.astype(np.float32)),
        )


def _fitted(machine: Machine, turn: int):
    def run(key, table):
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        label = table.column("label").to_numpy()
        places = [np.frombuffer(b, np.int32) for b in table.column("places").to_pylist()]
        values = [np.frombuffer(b, np.float32) for b in table.column("values").to_pylist()]
        rng = np.random.default_rng([turn, key[0].as_py()])
        for _ in range(EPOCHS):
            lot = rng.permutation(len(label))
            for a in range(0, len(lot), BATCH):
                ks = lot[a : a + BATCH]
                owner = np.repeat(np.arange(len(ks)), [len(places[k]) for k in ks])
                machine.learn(owner, np.concatenate([places[k] for k in ks]), np.concatenate([values[k] for k in ks]).astype(float), label[ks])
        flat_model = [machine.weights, machine.past, machine.factors.ravel(), machine.past_factors.ravel(), np.array([machine.bias])]
        return pa.table({"model": pa.array([np.concatenate(flat_model).tobytes()], pa.binary())})

    return run


def _machine(blob: bytes) -> Machine:
    x, m = np.frombuffer(blob, np.float64), Machine()
    m.weights, m.past, m.bias = x[:SIZE].copy(), x[SIZE : 2 * SIZE].copy(), float(x[-1])
    m.factors = x[2 * SIZE : (2 + RANK) * SIZE].reshape(SIZE, RANK).copy()
    m.past_factors = x[(2 + RANK) * SIZE : -1].reshape(SIZE, RANK).copy()
    return m


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most: int = MOST_TRAINING) -> Machine | float:
    """A machine from the labelled documents outside the held-out fold, or the share of label 1 if labels are all alike."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("other")
    )
    known = known.filter("label = other").filter(crc_mod(F.col("doc_id"), folds) != 0)
    ids = docs.filter("doc_id is not null").select("doc_id").distinct()
    place = F.xxhash64("doc_id")
    chosen = known.join(ids, "doc_id", "left_semi").select("doc_id", "label", place.alias("place")).orderBy("place", "doc_id").limit(most)
    chosen = saved(chosen, "chosen")
    share = chosen.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return 0.5 if share is None else float(share)
    told = chosen.select(F.col("doc_id").alias("of"), "label", "place", F.pmod("place", F.lit(SHARDS)).alias("shard"))
    sample = docs.select("doc_id", "text", "n_chars").join(F.broadcast(told), F.col("doc_id") == F.col("of"))
    examples = sample.mapInArrow(_examples, "shard long, place long, label double, places binary, values binary")
    examples = saved(examples, "examples")
    machine = Machine(float(np.log(share / (1 - share))))
    for turn in range(ROUNDS):
        models = examples.groupBy("shard").applyInArrow(_fitted(machine, turn), "model binary").collect()  # one for each shard
        machine = Machine.mean([_machine(r.model) for r in models])
    return machine


def score(docs: DataFrame, machine: Machine | float, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = crc_mod(F.col("doc_id"), folds) == 0
    if isinstance(machine, float):
        return docs.select("doc_id", held.alias("held_out"), F.lit(machine).alias("score"), F.lit(int(machine >= THRESHOLD)).alias("predicted"))
    weights, factors, bias = machine.weights.astype(np.float32), machine.factors.astype(np.float32), machine.bias

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
        told = Machine(bias)
        told.weights, told.factors = weights.astype(float), factors.astype(float)
        for batch in flat.blocks(batches, "text"):
            got = told.scores(*vectors(batch), batch.num_rows)
            yield flat.rows(schema, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=got)

    rows = docs.select("doc_id", held.alias("held_out"), "text", "n_chars")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most: int = MOST_TRAINING) -> DataFrame:
    if "n_chars" not in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return score(docs, fit(docs, labels, folds, most), folds)
