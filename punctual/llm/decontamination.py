"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every item is cut into windows of ten words (an item of fewer words is one window). The shingles (three words) of the
windows are the tokens of the join. One pass over the documents keeps the places where a token occurs, with the words
around; these places also give how often each token occurs. A window that holds a token that no document has cannot
occur. Of every other window only its rarest token is joined: a document that has the window has that token, at a known
offset, so the place fixes where the window would begin. Windows that would begin before the text or end after it are
dropped, and the rest are compared word by word.

The tokens are broadcast while their counted number stays within ``MOST_TOKENS``; beyond, places and tokens meet by a
shuffle. Nothing else is broadcast by request.

Defined cases: a null text or one without words has no hit, whichever side it is on; an item without an id marks words
but is no counted or listed item; repeated documents are reported one by one; repeated items count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.tables import lower_ascii, saved, text_key

WINDOW = 10
TOKEN = 3
#: 16 bytes each: the broadcast stays below 64 MB.
MOST_TOKENS = 2_000_000
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def _token(words: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from ``at`` (counted from 0)."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)])


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, window (its words) and length; one row for each different window of each item."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), word_list(F.col("text")).alias("words"))
    begins = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    cut = words.filter(F.size("words") > 0).select("item_id", "words", F.explode(begins).alias("at"))
    return cut.select("item_id", F.slice("words", F.col("at"), F.lit(width)).alias("window")).distinct()


def _tokens(window: DataFrame) -> DataFrame:
    """window, token, offset: every token of every window."""
    parts = []
    for width in range(1, TOKEN + 1):
        fit = F.size("window") >= TOKEN if width == TOKEN else F.size("window") == width
        at = F.explode(F.sequence(F.lit(0), F.size("window") - width))
        part = window.filter(fit).select("window", at.alias("offset"))
        parts.append(part.select("window", _token(F.col("window"), F.col("offset"), width).alias("token"), "offset"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def places(docs: DataFrame, tokens: DataFrame, widths: list[int], broadcast: bool) -> DataFrame:
    """Where a wanted token occurs, and the first place of every document.

    doc_id, text_key, n_words, at, token (null where only the document's first place is meant), around (words from
    ``at`` - 9 on), from (the place of the first of these).
    """
    words = docs.select("doc_id", text_key(), word_list(F.col("text")).alias("words"))
    each = words.select("doc_id", "text_key", "words", F.posexplode_outer("words").alias("at", "word"))
    keys = [_token(F.col("words"), F.col("at"), w) for w in widths]
    seen = F.when(F.col("at").isNotNull(), keys[0]) if len(keys) == 1 else None
    if seen is None:
        each = each.withColumn("seen", F.explode_outer(F.when(F.col("at").isNotNull(), F.array(*keys))))
    else:
        each = each.withColumn("seen", seen)
    start = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    around = F.slice("words", start + 1, F.lit(2 * WINDOW - 1))
    wanted = tokens
    columns = ["doc_id", "text_key", F.size("words").alias("n_words"), "at", F.col("seen")]
    if broadcast:
        met = each.join(F.broadcast(wanted), F.col("seen") == F.col("token"), "left")
        met = met.filter(F.col("token").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
        return met.select(*columns[:-1], "token", F.when(F.col("token").isNotNull(), around).alias("around"), start.alias("from"))
    narrow = each.select(*columns, around.alias("around"), start.alias("from"))
    met = narrow.join(wanted, F.col("seen") == F.col("token"), "left")
    met = met.filter(F.col("token").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
    return met.select("doc_id", "text_key", "n_words", "at", "token", "around", "from")


def decontaminate(docs: DataFrame, items: DataFrame, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, for every document."""
    window = saved(windows(items), "windows")
    tokens = saved(_tokens(window.select("window").distinct()), "tokens")
    wanted = saved(tokens.select("token").distinct(), "wanted")
    sizes = [r[0] for r in window.select(F.least(F.size("window"), F.lit(TOKEN))).distinct().collect()]  # three at most
    found = places(docs, wanted, sorted(sizes) or [TOKEN], wanted.count() <= most_tokens)
    found = saved(found, "places")

    hits = saved(_hits(found.filter("token is not null"), tokens), "hits")
    by_doc = ["doc_id", "text_key"]
    spans = hits.select(*by_doc, "start", (F.col("start") + F.size("window")).alias("end")).distinct()
    in_order = "partition by doc_id, text_key order by start, end"
    reached = F.expr(f"max(end) over ({in_order} rows between unbounded preceding and 1 preceding)")
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce("reached", F.lit(0))), F.lit(0))
    n_hit = spans.withColumn("reached", reached).groupBy(by_doc).agg(F.sum(new).cast("long").alias("n_hit"))

    of_items = hits.select(*by_doc, "window").distinct().join(window.filter("item_id is not null"), "window")
    listed = of_items.select(*by_doc, "item_id").distinct().groupBy(by_doc).agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items")
    )
    one_each = found.filter("coalesce(at, 0) = 0").groupBy(by_doc).agg(F.max("n_words").alias("n_words"))
    sums = one_each.join(*_same(n_hit)).drop("of_doc", "of_text").join(*_same(listed)).drop("of_doc", "of_text")
    rows = docs.select("doc_id", text_key())
    out = rows.join(*_same(saved(sums, "sums"))).drop("of_doc", "of_text")
    return out.select(
        *by_doc,
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _same(right: DataFrame) -> tuple[DataFrame, Column, str]:
    right = right.withColumnRenamed("doc_id", "of_doc").withColumnRenamed("text_key", "of_text")
    return right, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text")), "left"


def _hits(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, text_key, start, window: every window that occurs, confirmed on the words."""
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    rarest = tokens.join(counts, "token").groupBy("window").agg(
        F.min(F.struct("times", "offset", "token")).alias("rarest"), F.count(F.lit(1)).alias("n_met")
    )
    # A window some of whose tokens occur nowhere occurs nowhere.
    possible = F.col("n_met") == F.greatest(F.size("window") - TOKEN, F.lit(0)) + 1
    prefix = rarest.filter(possible).select(
        "window", F.col("rarest.token").alias("of_token"), F.col("rarest.offset").alias("offset")
    )
    start = F.col("at") - F.col("offset")
    within = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    same = F.slice("around", start - F.col("from") + 1, F.size("window")) == F.col("window")
    met = found.join(prefix, F.col("token") == F.col("of_token"))
    return met.filter(within).filter(same).select("doc_id", "text_key", start.alias("start"), "window").distinct()
