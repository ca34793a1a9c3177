"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The text is cut into words by the vocabulary's pattern; special tokens are cut out before. For every prefix of a word
there is exactly one token that can come last in its encoding, and it is found from left to right: a suffix automaton
of the vocabulary, fed byte by byte, gives the tokens that end where the prefix ends, longest first; such a token is the
one if it starts the word, or if it can stand after the last token of the prefix before it. Two tokens can stand side by
side if encoding their bytes gives back the two. That needs no encoding: replay the merges along the right edge of the
left token and the left edge of the right one by rank, and see whether any pair across the border would have merged
before either of its halves did. Back-pointers from the whole word give its ids, in time linear in its length.

The automaton and the merges depend on the vocabulary alone. They are built once and broadcast: about three entries for
each byte of the vocabulary's tokens, whatever the corpus. Texts are coded where they are read; nothing is shuffled.

Defined cases: a null or empty text has no ids and decodes to the empty text; rows are coded one by one, repeated ones
too, and null ids stay null; a text may have any length and so may a word; an empty table gives an empty one; columns
other than doc_id and text are ignored. Ids that the vocabulary lacks fail the decoding. Decoded bytes that are no
UTF-8 become the replacement character.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from punctual.llm import flat

# How the byte-level vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone.
ASCII_WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)

# Letters and numbers that Unicode has added since the version by which the vocabularies' library cuts.
SINCE = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)

#: So many words are remembered, and so many pairs of tokens.
REMEMBERED, PAIRS = 1 << 19, 1 << 20
#: Characters of a text, characters of all texts, and ids that are worked on at a time.
PIECE, TOGETHER, IDS = 1 << 16, 1 << 21, 1 << 16


class Vocabulary(NamedTuple):
    """Tokens by id, ``halves`` that each was merged from (-1 for single bytes), and strings that are cut out first."""

    tokens: list[bytes]
    halves: list[tuple[int, int]]
    special: dict[str, int]


def _letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes: those that print stand for themselves, the rest follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level vocabulary from a tokenizer's JSON file; any other kind is refused."""
    with open(path, encoding="utf-8") as lines:
        told = json.load(lines)
    model, cut = told["model"], told["pre_tokenizer"] or {}
    odd = [told["normalizer"], told["post_processor"], cut.get("type") != "ByteLevel", cut.get("add_prefix_space"), not cut.get("use_regex", True)]
    odd += [(told["decoder"] or {}).get("type") != "ByteLevel", model["type"] != "BPE"]
    odd += [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    odd += [t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
    if any(odd):
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    letter, ids = _letters(), model["vocab"]
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    tokens = [b""] * (1 + max([*ids.values(), *special.values()]))
    for text, k in ids.items():
        tokens[k] = bytes(letter[c] for c in text)
    for text, k in special.items():
        tokens[k] = text.encode()
    halves, last = [(-1, -1)] * len(tokens), -1
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        whole = ids[left + right]
        if whole <= last or ids[left] >= whole or ids[right] >= whole:
            raise ValueError(f"{path}: the ids of merged tokens do not follow the ranks of their merges")
        halves[whole], last = (ids[left], ids[right]), whole
    if sum(k not in special.values() and halves[k][0] < 0 for k in ids.values()) != 256:
        raise ValueError(f"{path}: not every token is one byte or a merge")
    return Vocabulary(tokens, halves, special)


class Automaton(NamedTuple):
    """A suffix automaton of all tokens: a state stands for the strings that occur at the same places in them."""

    step: dict[int, int]  # state * 256 + byte
    link: list[int]
    length: list[int]
    near: list[int]  # the first state on the way of links, itself included, that holds tokens; 0 if none
    held: dict[int, tuple[tuple[int, int], ...]]  # (length, token), longest first


def automaton(vocabulary: Vocabulary) -> Automaton:
    step, link, length, out = {}, [-1], [0], [[]]  # ``out``: the bytes on which a state has a step

    def new(size: int) -> int:
        link.append(-1)
        length.append(size)
        out.append([])
        return len(link) - 1

    def put(a: int, byte: int, b: int) -> None:
        if (a << 8 | byte) not in step:
            out[a].append(byte)
        step[a << 8 | byte] = b

    def split(a: int, byte: int, b: int) -> int:
        """A state for the strings of ``b`` that are no longer than those of ``a`` with ``byte``."""
        c = new(length[a] + 1)
        for x in out[b]:
            put(c, x, step[b << 8 | x])
        link[c], link[b] = link[b], c
        while a >= 0 and step.get(a << 8 | byte) == b:
            step[a << 8 | byte], a = c, link[a]
        return c

    def extended(a: int, byte: int) -> int:
        b = step.get(a << 8 | byte)
        if b is not None:
            return b if length[b] == length[a] + 1 else split(a, byte, b)
        z = new(length[a] + 1)
        while a >= 0 and (a << 8 | byte) not in step:
            put(a, byte, z)
            a = link[a]
        if a < 0:
            link[z] = 0
        else:
            b = step[a << 8 | byte]
            link[z] = b if length[b] == length[a] + 1 else split(a, byte, b)
        return z

    normal = [(k, t) for k, t in enumerate(vocabulary.tokens) if t and k not in vocabulary.special.values()]
    for _, token in normal:
        at = 0
        for byte in token:
            at = extended(at, byte)
    held: dict[int, list] = {}
    for k, token in normal:
        at = 0
        for byte in token:
            at = step[at << 8 | byte]
        held.setdefault(at, []).append((len(token), k))
    near = [0] * len(link)
    for state in sorted(range(1, len(link)), key=length.__getitem__):
        near[state] = state if state in held else near[link[state]]
    return Automaton(step, link, length, near, {s: tuple(sorted(x, reverse=True)) for s, x in held.items()})


def tables(path: str) -> tuple:
    """What coding needs, as plain values to be broadcast."""
    vocabulary = read_vocabulary(path)
    return tuple(vocabulary), tuple(automaton(vocabulary)), {}


def coder(plain: tuple) -> Coder:
    """The coder of broadcast tables: one a worker, which keeps what it has learned from task to task."""
    if not plain[2]:
        plain[2]["coder"] = Coder(plain)
    return plain[2]["coder"]


class Coder:
    """Encodes and decodes texts with the :func:`tables` of a vocabulary."""

    def __init__(self, plain: tuple):
        import regex

        self.vocabulary, self.automaton = Vocabulary(*plain[0]), Automaton(*plain[1])
        self.merged = {pair: k for k, pair in enumerate(self.vocabulary.halves) if pair[0] >= 0}
        self.since = re.compile(f"[{SINCE}]")
        odd = rf" ?(?:[^\s\p{{L}}\p{{N}}]|[{SINCE}])+"
        letters, numbers = (rf" ?(?:(?![{SINCE}])\p{{{c}}})+" for c in "LN")
        self.exact = regex.compile("|".join([r"'s|'t|'re|'ve|'m|'ll|'d", letters, numbers, odd, r"\s+(?!\S)|\s+"]))
        self.usual, self.ascii = regex.compile(WORDS), re.compile(ASCII_WORDS)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def beside(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of the two tokens gives the two."""
        halves, never = self.vocabulary.halves, len(self.vocabulary.halves)
        edge, other = [left], [right]  # pieces at the border, the last one first to live
        while halves[edge[-1]][0] >= 0:
            edge.append(halves[edge[-1]][1])
        while halves[other[-1]][0] >= 0:
            other.append(halves[other[-1]][0])
        i, j = len(edge) - 1, len(other) - 1
        while True:
            # A piece lives until it becomes part of the next; of equal ranks the merge further left comes first.
            until, other_until = edge[i - 1] if i else never, other[j - 1] if j else never
            whole = self.merged.get((edge[i], other[j]))
            if whole is not None and whole < until and whole <= other_until:
                return False
            if not i and not j:
                return True
            if until <= other_until:
                i -= 1
            else:
                j -= 1

    def _ending(self, state: int) -> tuple[tuple[int, int], ...]:
        """(length, token) of the tokens that are suffixes of the state's strings, longest first."""
        link, near, held = self.automaton.link, self.automaton.near, self.automaton.held
        out, at = [], near[state]
        while at:
            out += held[at]
            at = near[link[at]]
        self.ends[state] = tuple(out)
        return self.ends[state]

    def words(self, ordered: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of words in byte order: what two neighbours share at their front is worked out once.

        ``last`` holds for every prefix of the word at hand the token that comes last in its encoding, ``states`` and
        ``lengths`` where the automaton stands there and how many bytes it has matched.
        """
        step, link, length = self.automaton.step.get, self.automaton.link, self.automaton.length
        pairs, ends, tokens = self.pairs, self.ends, self.vocabulary.tokens
        last, states, lengths = [-1], [0], [0]
        out, before = [], b""
        for word in ordered:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], states[same + 1 :], lengths[same + 1 :]
            state, matched, end, before = states[-1], lengths[-1], same, word
            for byte in word[same:]:
                end += 1
                to = step(state << 8 | byte)
                while to is None:  # every byte is a token, so the empty string has a step
                    state = link[state]
                    matched = length[state]
                    to = step(state << 8 | byte)
                state = to
                matched += 1
                for size, token in ends.get(state) or self._ending(state):
                    if size > matched:
                        continue
                    if size == end:
                        break
                    pair = last[end - size] << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.beside(pair >> 32, token)
                    if fits:
                        break
                last.append(token)
                states.append(state)
                lengths.append(matched)
            ids = []
            while end:
                token = last[end]
                ids.append(token)
                end -= len(tokens[token])
            out.append(tuple(reversed(ids)))
        return out

    def _pieces(self, text: str):
        """The text in pieces that no word crosses: they end before a blank that follows no white space."""
        at = 0
        while at < len(text):
            to = at + PIECE
            while to < len(text) and not (text[to] == " " and not text[to - 1].isspace()):
                to = text.find(" ", to + 1)
                to = len(text) if to < 0 else to
            yield text[at:to]
            at = to

    def _cut(self, text: str):
        """The words of a text, some at a time, and the ids of special tokens; each with its number of characters."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield len(part), self.vocabulary.special[part]
                continue
            for piece in self._pieces(part):
                words = self.ascii if piece.isascii() else self.exact if self.since.search(piece) else self.usual
                yield len(piece), words.findall(piece)

    def _learn(self, parts: list) -> None:
        """Work out the words of ``parts`` that are not known."""
        fresh = set()
        for words in parts:
            if not isinstance(words, int):
                fresh.update(words)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
        ordered = sorted(fresh.difference(self.known))
        self.known.update(zip(ordered, self.words([w.encode() for w in ordered])))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text. Words are gathered over the texts, up to so many characters at a time."""
        out: list[list] = [[] for _ in texts]
        waiting: list[tuple[int, list]] = []
        size = 0

        def flush() -> None:
            self._learn([words for _, words in waiting])
            known = self.known.__getitem__
            for k, words in waiting:
                ids = [words] if isinstance(words, int) else chain.from_iterable(map(known, words))
                out[k].append(np.fromiter(ids, np.int32))
            waiting.clear()

        for k, text in enumerate(texts):
            for chars, words in self._cut(text or ""):
                waiting.append((k, words))
                size += chars
                if size >= TOGETHER:
                    flush()
                    size = 0
        flush()
        return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]

    def pieces(self, ids: np.ndarray):
        """The bytes of the ids, some at a time."""
        for at in range(0, len(ids), IDS):
            yield b"".join(map(self.vocabulary.tokens.__getitem__, ids[at : at + IDS].tolist()))

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and int(ids.min()) < 0:
            raise IndexError("no token has a negative id")
        return b"".join(self.pieces(ids)).decode("utf-8", "replace")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values.astype(np.int32))).cast(pa.list_(pa.int32()))


def _encoded(coder: Coder, batches):
    for batch in batches:
        for part in flat.blocks([batch], "text"):
            ids = coder.encode(part.column("text").to_pylist())
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, _lists(ids)], ["doc_id", "n_tokens", "ids"])


def _decoded(coder: Coder, batches):
    for batch in batches:
        texts = [coder.decode(np.asarray(x.values)) if x.is_valid else "" for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _digests(coder: Coder, batches):
    names = [str(k) for k in range(len(coder.vocabulary.tokens))]

    def of_ids(ids: np.ndarray) -> str:
        told = hashlib.sha256()
        for at in range(0, len(ids), IDS):
            told.update((("," if at else "") + ",".join(map(names.__getitem__, ids[at : at + IDS].tolist()))).encode())
        return told.hexdigest()

    for batch in _encoded(coder, batches):
        ids = pa.array([of_ids(np.asarray(x.values)) for x in batch.column("ids")], pa.string())
        text = pa.array([hashlib.sha256(t.as_py().encode()).hexdigest() for b in _decoded(coder, [batch]) for t in b.column("text")], pa.string())
        named = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), ids, text], named)


def _mapped(df: DataFrame, work, path: str, columns: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(tables(path))

    def run(batches):
        return work(coder(sent.value), batches)

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, {columns}")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids of every text of ``docs`` (doc_id, text), by the vocabulary in the file ``path``."""
    return _mapped(docs.select("doc_id", "text"), _encoded, path, "n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids)."""
    return _mapped(encoded.select("doc_id", "ids"), _decoded, path, "text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them: encode and decode in one pass."""
    return _mapped(docs.select("doc_id", "text"), _digests, path, "n_tokens long, ids_sha256 string, decoded_sha256 string")
