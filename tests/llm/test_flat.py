import numpy as np
import pyarrow as pa
from corpus import WORD, documents

from punctual.llm import flat


def test_words_of_flat_texts_are_those_of_each_text():
    texts = [r[1] for r in documents()]
    data, offsets = flat.flat(pa.array(texts))
    start, end, owner = flat.words(data, offsets)
    got = [[] for _ in texts]
    for a, b, k in zip(start, end, owner):
        got[k].append(bytes(data[a:b]).decode())
    assert got == [WORD.findall(t or "") for t in texts]


def test_equal_spans_have_equal_hashes_and_others_not():
    data, offsets = flat.flat(pa.array(["abcab", "cabc", None, ""]))
    sums = flat.prefix(data)
    spans = [(a, b) for a in range(9) for b in range(a + 1, 10)]
    hashes = flat.spans(sums, np.array([a for a, _ in spans]), np.array([b for _, b in spans])).tolist()
    by_bytes = {}
    for (a, b), h in zip(spans, hashes):
        by_bytes.setdefault(bytes(data[a:b]), set()).add(h)
    assert all(len(x) == 1 for x in by_bytes.values())
    assert len(set(hashes)) == len(by_bytes)


def test_sliced_null_and_empty_columns():
    column = pa.array(["a b", None, "c", "", "dé"])
    data, offsets = flat.flat(column.slice(1, 4))
    assert bytes(data) == "cdé".encode() and offsets.tolist() == [0, 0, 1, 1, 4]
    for empty in (pa.array([], pa.string()), pa.array([None, None], pa.string())):
        data, offsets = flat.flat(empty)
        assert len(data) == 0 and offsets.tolist() == [0] * (len(empty) + 1)


def test_blocks_keep_every_row_in_order():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 1, 0, 9, 2, 2)] + [None], "k": list(range(7))})
    parts = list(flat.blocks([batch], "text", 4))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(7))
    assert max(sum(map(len, filter(None, p.column("text").to_pylist()))) for p in parts) == 9


def test_hashes_by_steps_are_the_same():
    data, offsets = flat.flat(pa.array([r[1] for r in documents()]))
    start, end, _ = flat.words(data, offsets)
    whole = flat.spans(flat.prefix(data), start, end)
    for step in (1, 50, 1 << 20):
        assert (flat.hashes(data, start, end, step) == whole).all()
