"""Language-model scores by prediction by partial matching.

A text is a sequence of tokens: its words, and one end. The model spells each token byte by byte, with a separator
after it. A byte is predicted from the up to ``ORDER`` bytes before it in the running text: the separator and the end of
the words before count, and separators stand before the first word. With ``by_word`` every token is spelt on its own
instead, after separators. The trie of contexts and the bytes that followed them is counted over all training texts. A context that has seen T bytes, D
different ones, gives a byte seen n times (2n - 1) / 2T and the escape D / 2T; after an escape the next shorter
context predicts, without the bytes that the longer ones would have predicted. After the empty context every byte left
is alike.

All work runs on blocks of text. A block asks for what it contains, each different word and each different (context,
byte) once, with how often its training texts have it. Requests meet by key: there they are summed to the counts of the
corpus, the costs of (context, byte) are worked out once for all, and the answers go back to the block, which adds them
up by text. So no table is broadcast, and the requests grow with the input.

Words are told by 64-bit hashes; costs travel as 32-bit numbers. Defined cases: a null or empty text is its end alone; rows are scored one by one and
count one by one, repeated ones too; a null id counts as the empty text in the split; without training texts all counts
are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm import flat
from punctual.llm.tables import crc_mod, pieces, released, saved

ORDER = 6
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES, RUNNING_BYTES = 16 << 20, 4 << 20  # running text has far more different (context, byte)
SEPARATOR, END = 0x20, b"\n"

_U = np.uint64
_PACKED = "block long, kind int, bucket long, keys binary, counts binary"


def _planes(x: np.ndarray) -> bytes:
    """The numbers as bytes, all first bytes before all second ones: sorted and small numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(planes: bytes, kind) -> np.ndarray:
    bytes_ = np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(bytes_.T).reshape(-1).view(kind)


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after the other, and where each begins, with the end last."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _spellings(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) as one number for every byte of every word and the separator after it, and the word's number."""
    n, size = len(offsets) - 1, np.diff(offsets)
    wide = size + order + 1  # separators before, one after
    begin = np.concatenate([[0], np.cumsum(wide)])
    text = np.full(begin[-1], SEPARATOR, np.uint8)
    inside = np.zeros(len(text) + 1, np.int8)  # where the spans' own bytes lie
    np.add.at(inside, begin[:-1] + order, 1)
    np.add.at(inside, begin[:-1] + order + size, -1)
    np.cumsum(inside, out=inside)
    text[inside[:-1].astype(bool)] = data
    del inside
    key = np.zeros(len(text), _U)
    for k in range(order + 1):
        key[order:] |= text[order - k : len(text) - k].astype(_U) << _U(8 * k)
    use = np.ones(len(text), bool)
    for k in range(order):
        use[begin[:-1] + k] = False
    return key[use], np.repeat(np.arange(n, dtype=np.int32), size + 1)


def _different(spelt: np.ndarray, learn: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in ``spelt``, and how often each is to be learnt; 0 and 1 in ``learn``, one for each of ``spelt``."""
    if order > 6:  # no bit is left in the number
        different, number = np.unique(spelt, return_inverse=True)
        return different, np.bincount(number, learn, len(different)).astype(np.int64)
    packed = (spelt << _U(1)) | learn.astype(_U)
    packed.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(packed)), bool), (packed[1:] ^ packed[:-1]) > 1]))
    learnt = np.add.reduceat((packed & _U(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return packed[first] >> _U(1), learnt


def _running(data: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every text, its tokens parted by one separator and its end last, and where each text begins."""
    last = np.cumsum(sizes + 1) - 1
    whole = np.zeros(len(tokens) + len(sizes), np.int64)
    inner = np.ones(len(whole), bool)
    inner[last] = False
    whole[inner] = tokens
    size = np.diff(offsets)[whole]
    letters, _ = _gather(data, offsets[whole], offsets[whole + 1])
    ends = np.cumsum(size + inner)
    out = np.full(int(ends[-1]) if len(ends) else 0, SEPARATOR, np.uint8)
    begin = ends - size - inner
    out[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(letters))] = letters
    return out, np.concatenate([[0], ends[last]]).astype(np.int64)


def _block(batch, order: int) -> dict:
    """Different words of one block (the end first), the tokens by word number, and how often training texts have a word."""
    data, offsets = flat.flat(batch.column("text"))
    data = flat.LOWER[data]
    start, end, text = flat.words(data, offsets)
    keys = flat.hashes(data, start, end)
    different, first, number = np.unique(keys, return_index=True, return_inverse=True)
    learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.bincount(number, learn[text], len(different)).astype(np.int64)
    words, at = _gather(data, start[first], end[first])
    return {
        "data": np.concatenate([np.frombuffer(END, np.uint8), words]),
        "offsets": np.concatenate([[0], at + 1]),
        "tokens": (number + 1).astype(np.int32),
        "sizes": np.bincount(text, minlength=batch.num_rows),
        "counts": np.concatenate([[learn.sum()], count]),
        "learn": learn,
    }


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return flat.hashes(data, offsets[:-1], offsets[1:])


def _order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key, and the order in which a block asks for its keys: answers come back in it, without the keys."""
    bucket = (flat.mix(keys) % _U(buckets)).astype(np.int64)
    return bucket, np.lexsort((keys, bucket))


def _asks(order: int, buckets: int, by_word: bool, block_bytes: int):
    def run(batches):
        fields = [("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
        fields += [("ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_()))]
        fields += [(c, pa.binary()) for c in ("data", "offsets", "tokens", "sizes")]
        schema = pa.schema(fields)
        task = np.random.SeedSequence().entropy & ((1 << 62) - 1)  # only told apart, and written down before use
        for k, batch in enumerate(flat.blocks(batches, "text", block_bytes)):
            got = _block(batch, order)
            block = int(flat.mix(np.array([task + k], _U)).view(np.int64)[0])
            whole = {c: pa.array([_planes(got[c])], pa.binary()) for c in ("data", "offsets", "tokens", "sizes")}
            none = pa.array([None], pa.binary())
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
            held = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.compute.invert(batch.column("learn")))
            yield flat.rows(schema, block=[block], kind=[0], bucket=[0], keys=none, counts=none, ids=ids, held_out=held, **whole)
            parts = (got["data"], got["offsets"])
            spelt, owner = _spellings(*(parts if by_word else _running(*parts, got["tokens"], got["sizes"])), order)
            if by_word:
                different, number = np.unique(spelt, return_inverse=True)
                times = np.bincount(number, got["counts"][owner], len(different)).astype(np.int64)
            else:
                different, times = _different(spelt, got["learn"].astype(bool)[owner], order)
            del spelt, owner
            for kind, keys, counts in ((1, _word_keys(got["data"], got["offsets"]), got["counts"]), (2, different, times)):
                bucket, rank = _order(keys, buckets)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[rank][1:] != bucket[rank][:-1]]))
                ends, m = np.append(cuts[1:], len(rank)), len(cuts)
                cut = lambda x: pa.array([_planes(x[rank[a:b]]) for a, b in zip(cuts, ends)], pa.binary())
                empty = {c: pa.nulls(m, schema.field(c).type) for c in ("ids", "held_out", "data", "offsets", "tokens", "sizes")}
                yield flat.rows(
                    schema, block=np.full(m, block), kind=np.full(m, kind), bucket=bucket[rank[cuts]], keys=cut(keys), counts=cut(counts), **empty
                )

    return run


def _joined(table, column: str, kind) -> np.ndarray:
    parts = [_numbers(b, kind) for b in table.column(column).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _sums(table) -> tuple[np.ndarray, np.ndarray]:
    keys, number = np.unique(_joined(table, "keys", _U), return_inverse=True)
    return keys, np.bincount(number, _joined(table, "counts", np.int64), len(keys)).astype(np.int64)


def _counted(key, table):
    """Answers to the requests for words of one bucket, and in its first row ``known``: keys of the bucket with a count."""
    keys, counts = _sums(table)
    return _answers(table, keys, counts, int((counts > 0).sum()))


def _answers(table, keys: np.ndarray, values: np.ndarray, known: int):
    """block, kind, bucket, values: to every request the values of its keys, in its order."""
    told = [_planes(values[np.searchsorted(keys, _numbers(blob, _U))]) for blob in table.column("keys").to_pylist()]
    first = [known] + [0] * (len(told) - 1)
    same = {c: table.column(c) for c in ("block", "kind", "bucket")}
    return pa.table({**same, "values": pa.array(told, pa.binary()), "known": pa.array(first[: len(told)], pa.int64())})


def _totals(key, table):
    keys, counts = _sums(table)
    return pa.table({"key": pa.array(keys.view(np.int64)), "n": pa.array(counts)})


def _priced(key, table):
    """Answers to the requests for (context, byte) of one bucket, whose costs come in rows of their own."""
    kinds = table.column("kind").to_numpy()
    prices, asks = table.filter(pa.array(kinds == 3)), table.filter(pa.array(kinds == 2))
    keys, values = _joined(prices, "keys", _U), _joined(prices, "counts", np.float64)
    rank = np.argsort(keys)
    return _answers(asks, keys[rank], values[rank].astype(np.float32), 0)


def _costs(spelt: DataFrame, order: int) -> DataFrame:
    """(key, cost): log10 of the probability of the byte after the context, for every (context, byte) in ``spelt`` (key, n)."""

    def context(k: int) -> Column:
        return F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * k) - 1))

    byte = F.col("key").bitwiseAND(F.lit(255)).cast("int")
    open_ = spelt.select("key", byte.alias("byte"), F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("gone"))
    done = []
    for k in range(order, -1, -1):
        seen = spelt.filter("n > 0").groupBy(context(k).alias("context"), byte.alias("next")).agg(F.sum("n").alias("n"))
        trie = seen.groupBy("context").agg(F.collect_list(F.struct("next", "n")).alias("nexts"))  # 256 at most
        trie = F.broadcast(trie) if k == 0 else trie
        met = open_.withColumn("at", context(k)).join(trie, F.col("at") == F.col("context"), "left")
        left = F.filter(F.coalesce("nexts", F.array()), lambda x: ~F.array_contains(F.col("gone"), x["next"]))
        met = met.select("key", "byte", "cost", "gone", left.alias("left"))
        total = F.aggregate("left", F.lit(0).cast("long"), lambda t, x: t + 2 * x["n"])
        hit = F.get(F.filter("left", lambda x: x["next"] == F.col("byte")), F.lit(0))["n"]
        met = met.withColumn("total", total).withColumn("hit", hit)
        step = F.coalesce(2 * F.col("hit") - 1, F.size("left"))
        met = met.select(
            "key", "byte", (F.col("cost") + F.when(F.size("left") > 0, F.log10(step / F.col("total"))).otherwise(0.0)).alias("cost"),
            F.concat("gone", F.transform("left", lambda x: x["next"])).alias("gone"), F.col("hit").isNotNull().alias("done"),
        )
        met = saved(met, "order")
        done.append(met.filter("done").select("key", "cost"))
        open_ = met.filter("not done").drop("done")
    rest = open_.select("key", (F.col("cost") - F.log10(256 - F.size("gone"))).alias("cost"))
    for more in done:
        rest = rest.unionByName(more)
    return rest


def _scored(order: int, buckets: int, by_word: bool):
    """The texts of one block: doc_id, held_out, n_tokens, n_known, sum of log10(c + 1), score."""

    def run(key, table):
        kinds = table.column("kind").to_numpy()
        own = table.filter(pa.array(kinds == 0)).to_pylist()[0]
        data, offsets, tokens, sizes = (_numbers(own[c], t) for c, t in (("data", np.uint8), ("offsets", np.int64), ("tokens", np.int32), ("sizes", np.int64)))

        def told(kind: int, keys: np.ndarray, number) -> np.ndarray:
            part = table.filter(pa.array(kinds == kind)).sort_by("bucket")
            values = _joined(part, "values", number)
            out = np.empty_like(values)
            out[_order(keys, buckets)[1]] = values
            return out

        count = told(1, _word_keys(data, offsets), np.int64)
        spelt, owner = _spellings(*((data, offsets) if by_word else _running(data, offsets, tokens, sizes)), order)
        different, number = np.unique(spelt, return_inverse=True)
        cost = np.bincount(owner, told(2, different, np.float32).astype(float)[number], len(offsets) - 1 if by_word else len(sizes))
        text = np.repeat(np.arange(len(sizes)), sizes)

        def by_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(text, values[tokens], len(sizes)) + values[0]

        return pa.table(
            {
                "doc_id": pa.array(own["ids"], pa.int64()),
                "held_out": pa.array(own["held_out"], pa.bool_()),
                "n_tokens": pa.array(sizes + 1),
                "n_known": pa.array(by_text((count > 0).astype(float)).astype(np.int64)),
                "logs": pa.array(by_text(np.log10(count + 1))),
                "score": pa.array(by_text(cost) if by_word else cost),
            }
        )

    return run


def score(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, held_out: int = HELD_OUT, by_word: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word frequencies) and score (this model)."""
    if not 1 <= order <= 7:
        raise ValueError("a context has 1 to 7 bytes")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = BLOCK_BYTES if by_word else RUNNING_BYTES
    buckets = pieces(total, block_bytes)
    named = docs.select("doc_id", (crc_mod(F.col("doc_id"), folds) != held_out).alias("learn"), "text")
    own = "ids array<long>, held_out array<boolean>, data binary, offsets binary, tokens binary, sizes binary"
    asked = saved(named.mapInArrow(_asks(order, buckets, by_word, block_bytes), f"{_PACKED}, {own}"), "asks")

    answer = "block long, kind int, bucket long, values binary, known long"
    words = asked.filter("kind = 1").select("block", "kind", "bucket", "keys", "counts")
    words = saved(words.groupBy("bucket").applyInArrow(_counted, answer), "words")
    grams = asked.filter("kind = 2").select("block", "kind", "bucket", "keys", "counts")
    spelt = saved(grams.groupBy("bucket").applyInArrow(_totals, "key long, n long"), "spelt")
    released(docs.sparkSession)
    prices = _costs(spelt, order).select(F.lit(0).cast("long").alias("block"), F.lit(3).alias("kind"), "key", "cost")
    packed = prices.mapInArrow(_packed(buckets), _PACKED)
    costs = saved(grams.unionByName(packed).groupBy("bucket").applyInArrow(_priced, answer), "costs")
    released(docs.sparkSession)

    one = asked.filter("kind = 0").select("block", "kind", "bucket", "ids", "held_out", "data", "offsets", "tokens", "sizes")
    answers = words.unionByName(costs).select("block", "kind", "bucket", "values")
    texts = one.unionByName(answers, allowMissingColumns=True).groupBy("block").applyInArrow(
        _scored(order, buckets, by_word), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
    )
    texts = saved(texts, "scored")
    released(docs.sparkSession)
    n = texts.filter("not held_out").agg(F.sum("n_tokens")).first()[0] or 0
    v = words.agg(F.sum("known")).first()[0] or 0
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return texts.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def _packed(buckets: int):
    """Rows of (key, cost) as packed rows by bucket."""

    def run(batches):
        schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            keys, costs = batch.column("key").to_numpy().view(_U), batch.column("cost").to_numpy()
            if not len(keys):
                continue
            bucket = (flat.mix(keys) % _U(buckets)).astype(np.int64)
            rank = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], bucket[rank][1:] != bucket[rank][:-1]]))
            ends, m = np.append(cuts[1:], len(rank)), len(cuts)
            cut = lambda x: pa.array([_planes(x[rank[a:b]]) for a, b in zip(cuts, ends)], pa.binary())
            yield flat.rows(schema, block=np.zeros(m, np.int64), kind=np.full(m, 3), bucket=bucket[rank[cuts]], keys=cut(keys), counts=cut(costs))

    return run
