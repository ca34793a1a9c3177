"""Small tables with every odd case, and plain readings of the contracts to hold the operators against."""

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, key string, n long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(seed=0, n=60):
    """Prose, copies, near copies, repeated lines, nulls, empty and very long texts, repeated rows, ties, null ids."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(90)
    texts = [None, "", " \t\n", "one", "one two three four", "A\x00b Éa ÉA", "x" * 3000, "word " * 400]
    texts += [prose(rng.randint(5, 200)) for _ in range(n)]
    base = prose(150).split()
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(1000)
        texts.append(" ".join(copy))
    texts += [texts[20]] * 4 + [texts[21] + "\n" + passage, passage + " " + texts[22], (texts[23] + "\n") * 5]
    texts += [prose(6000), "Ab!! CD!! " * 80, "a### b*** c$$$ " * 40]
    rows = [(k, t, "en", ["s1", "s2", None, "s10"][k % 4], None if t is None else len(t), "c", "k", 1) for k, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, texts[24], None, None, None, None, None, None), (None, texts[24], None, "s1", 5, "c", "k", 2)]
    return rows


def shingles(text, width=5):
    words = WORD.findall(lower(text))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n
