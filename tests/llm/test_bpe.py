"""Encoding by prefixes against the tokenizers library."""

import hashlib
import random

import pytest
from corpus import DOC_SCHEMA, documents

from punctual.llm import bpe
from punctual.llm.queries import VOCABULARIES

PATH = f"{VOCABULARIES}/byte_bpe_50k.json"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.tables(PATH))


@pytest.fixture(scope="module")
def library():
    whole = tokenizers.Tokenizer.from_file(PATH)
    whole.no_truncation()
    whole.no_padding()
    return whole


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_texts_as_the_library_codes_them(spark, coder, library):
    rows = documents() + [(900, "<|endoftext|>a <|endoftext|> b<|endoftext|>", "en", "s", 1, "c", "k", 1), (901, "it's we'll I'D  \n\n x　y 漢字 ½ ՘", "en", "s", 1, "c", "k", 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    want = sorted((str(r[0]), ids(library, r[1]), r[1] or "") for r in rows)
    encoded = bpe.encode(docs, PATH)
    got = encoded.collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == [w[:2] for w in want]
    assert sorted((str(r["doc_id"]), r["text"]) for r in bpe.decode(encoded, PATH).collect()) == sorted((a, c) for a, _, c in want)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    told = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, PATH).collect()]
    assert sorted(told) == sorted((a, len(b), sha(",".join(map(str, b))), sha(library.decode(b, skip_special_tokens=False))) for a, b, _ in want)
    assert all(c == library.decode(b, skip_special_tokens=False) for _, b, c in want)


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids string, n_tokens int")
    assert bpe.encode(docs, PATH).collect() == [] and bpe.digests(docs, PATH).collect() == []
    one = spark.createDataFrame([(None, None, "x", 3)], "doc_id long, text string, ids string, n_tokens int")
    assert [tuple(r) for r in bpe.encode(one, PATH).collect()] == [(None, 0, [])]


def test_every_code_point(coder, library):
    rng = random.Random(3)
    for low in range(0, 0x110000, 128):
        letters = [chr(x) for x in range(low, low + 128) if not 0xD800 <= x < 0xE000]
        text = "".join(rng.choice(["", " ", "  ", "\n", "1", "x", "'s", "!"]) + c for c in letters)
        assert list(coder.encode([text])[0]) == ids(library, text), hex(low)


def test_random_words(coder, library):
    rng = random.Random(4)
    for k in range(4000):
        letters = rng.choice(["ab", "aab ", "abc \n", "theinr ", "0123 ", "é漢字a ", "'stredvm l", " \t\n "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + ("<|endoftext|>" if k % 7 == 0 else "")
        assert list(coder.encode([text])[0]) == ids(library, text)


def test_long_words_and_small_pieces(coder, library, monkeypatch):
    for text in ("x" * 200_000, "ab" * 50_000, "né" * 30_000 + " b" * 70_000):
        assert list(coder.encode([text])[0]) == ids(library, text)
    monkeypatch.setattr(bpe, "PIECE", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    for row in documents(1):
        assert list(coder.encode([(row[1] or "")[:2000]])[0]) == ids(library, (row[1] or "")[:2000])


def test_two_tokens_side_by_side(coder, library):
    rng = random.Random(5)
    tokens = coder.vocabulary.tokens
    words = [k for k, t in enumerate(tokens[:50256]) if t.isalpha() and t.isascii()]
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        assert coder.beside(a, b) == (ids(library, (tokens[a] + tokens[b]).decode()) == [a, b])


def test_ids_that_are_none(coder):
    import numpy as np

    for odd in (-1, 50257, 10**9):
        with pytest.raises(IndexError):
            coder.decode(np.array([5, odd]))
    assert coder.decode(np.zeros(0, np.int32)) == ""
    assert "�" in coder.decode(np.array([[k for k, t in enumerate(coder.vocabulary.tokens) if t == b"\xff"][0]]))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.read_vocabulary(f"{VOCABULARIES}/word_bpe_49k.json")
