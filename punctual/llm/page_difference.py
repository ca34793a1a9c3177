"""Main text of web pages: the difference to the page with the nearest URL, with the markup as a guard.

A page is cut into blocks of text. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are told by their elements, roles and class names and go. Every page is aligned with the nearest page of
the same host by a longest common subsequence of all blocks, and blocks that both pages have are furniture of the host
and go too, but for the text of an article (or main) element: what stands there in a paragraph, heading, list item or
other element of text stays, whatever pages share it, unless it is nothing but links. In an article without elements of
text, all that is no link is text. Every other block stays if the nearest page lacks it, within an article or outside.
The alignment knows blocks by 64-bit hashes, and only hashes are ordered: texts never leave their task, unless the pages
that lose blocks are too many to send to every task.

Pages of a host with equal blocks are folded to one, which stands at the least of their URLs; what it loses, all copies
lose. Nearest is the neighbour in the order of URL paths that shares the longer beginning of the path (the earlier one if
both share as much); pages without blocks are nobody's neighbours. The order is made by a range partitioning, so a host
may hold any share of all pages; neighbours across partitions meet through one row per partition.

Defined cases: a null or empty page has an empty text; a null URL forms a host of its own; copies, repeated rows too, have
the same text, and a host of nothing but copies keeps it whole; unclosed elements end with what holds them, an unclosed
comment at the end of the page; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm import flat
from punctual.llm.tables import saved

# Names of elements and of their usual classes.
FURNITURE = frozenset(
    "head title nav footer aside form script style noscript template button select option textarea svg iframe dialog menu object canvas audio video".split()
)
TEXT = frozenset("p li dd dt td th caption figcaption blockquote pre address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE_ONLY = frozenset(["header"])  # an article has a header of its own
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLASS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|notification|popup|modal|"
    r"overlay|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|share|sharing|social|related|comments?|commentlist|"
    r"replies|reply|respond|disqus\w*|newsletter|subscribe|signup|login|widget|pagination|pager|skip|hidden)(?=$|[\s_-])",
    re.I,
)
HEADERS = re.compile(r"(?:^|[\s_-])(?:header|topbar|toolbar)(?=$|[\s_-])", re.I)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

MAIN, OPEN, DROPPED = 0, 1, 2
_LOOSE, _LINKS = 3, 4  # in an article, but in no element of text, or links alone


def _is_furniture(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in FURNITURE or (tag in PAGE_ONLY and not in_main):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and (CLASS.search(value) or (not in_main and HEADERS.search(value))):
            return True
        if (name == "role" and value.lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and HIDDEN.search(value):
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with what it is: MAIN (text of an article), DROPPED, or OPEN to the alignment."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []  # element, in furniture, main, text, heading, link
    outside = (False,) * 5
    furniture, main, held, heading, link = outside
    written = plain = False  # an article with elements of text; a block that is more than links
    words: list[str] = []

    def flush() -> None:
        nonlocal written, plain
        text = BLANKS.sub(" ", "".join(words)).strip(" ")
        words.clear()
        if text:
            kind = MAIN if heading or (held and plain) else _LOOSE if plain else _LINKS
            kind = DROPPED if furniture else kind if main else OPEN
            written = written or (kind == MAIN and held)
            out.append((text, kind))
        plain = False

    at = 0
    while True:
        found = TAG.search(page, at)
        words.append(html.unescape(page[at : found.start() if found else len(page)]))
        plain = plain or not (link or words[-1].isspace() or not words[-1])
        if not found:
            break
        at = found.end()
        close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            words.append(" ")
        if tag in VOID:
            if tag not in INLINE and tag != "br":
                flush()
            continue
        if tag not in INLINE:
            flush()
        if close:
            top = len(stack)  # where the element to close stands; an inline one closes no block
            while top and stack[top - 1][0] != tag and (tag not in INLINE or stack[top - 1][0] in INLINE):
                top -= 1
            if top and stack[top - 1][0] == tag:
                now = stack[top - 2][1:] if top > 1 else outside
                if now[:2] != (furniture, main):
                    flush()
                furniture, main, held, heading, link = now
                del stack[top - 1 :]
            continue
        if attributes.endswith("/") and tag in RAW:
            continue
        inner = furniture or _is_furniture(tag, attributes, main)
        if inner != furniture:
            flush()
        main = main or tag in ("article", "main")
        furniture, held, heading = inner, held or tag in TEXT, heading or tag in HEADINGS
        link = tag == "a" or (link and tag in INLINE)  # an unclosed link ends with its block
        stack.append((tag, furniture, main, held, heading, link))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return [(t, kind if kind < _LOOSE else MAIN if kind == _LOOSE and not written else OPEN) for t, kind in out]


def _rows(a: list, b: list):
    """One bit vector for each prefix of ``a``: its cleared bits are where the common subsequence with ``b`` grows."""
    full, at = (1 << len(b)) - 1, {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << k)
    row = full
    yield row
    for x in a:
        met = row & at.get(x, 0)
        row = ((row + met) | (row - met)) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and every prefix of ``b``."""
    row = deque(_rows(a, b), maxlen=1)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list, b: list, most_bits: int = 1 << 28) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``; memory stays below ``most_bits`` plus the lists."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    ends = list(range(head)), list(range(len(a) - tail, len(a)))
    if not x or not y:
        return ends[0] + ends[1]
    if len(x) * len(y) > most_bits and len(x) > 1:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        inner = common(x[:half], y[:cut], most_bits) + [half + k for k in common(x[half:], y[cut:], most_bits)]
        return ends[0] + [head + k for k in inner] + ends[1]
    rows, i, j, inner = list(_rows(x, y)), len(x), len(y), []
    while i and j:
        grows = not rows[i] >> (j - 1) & 1
        if not grows:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            inner.append(head + i - 1)
            i, j = i - 1, j - 1
    return ends[0] + inner[::-1] + ends[1]


def _address(url: str | None) -> tuple[str | None, str]:
    if url is None:
        return None, ""
    rest = url.split("://", 1)[-1]
    host, _, path = rest.partition("/")
    return host.lower(), re.split(r"[?#]", path, maxsplit=1)[0]


def _content(blocks: list[tuple[str, int]]) -> bytes:
    """Equal for equal blocks, and else different."""
    return hashlib.sha256("".join(f"{kind}{len(t)}:{t}" for t, kind in blocks).encode(errors="surrogatepass")).digest()


def _hashes(blocks: list[tuple[str, int]]) -> list[int]:
    number = lambda t: hashlib.blake2b(t.encode(errors="surrogatepass"), digest_size=8).digest()
    return [int.from_bytes(number(t), "little", signed=True) for t, _ in blocks]


def _pages(batches, schema: pa.Schema, more):
    """One row a page: its id, where it lies, its content, and what ``more`` makes of its blocks."""
    for batch in flat.blocks(batches, "html", 1 << 20):
        got = {c: [] for c in schema.names}
        for page_id, url, page in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            blocks = blocks_of(page or "")
            host, path = _address(url)
            row = {"page_id": page_id, "url": url, "host": host, "path": path, "content": _content(blocks), **more(blocks)}
            for c in schema.names:
                got[c].append(row[c])
        yield flat.rows(schema, **got)


def _cut(batches):
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("content", pa.binary())]
        + [("blocks", pa.list_(pa.int64())), ("open", pa.list_(pa.int32()))]
    )
    return _pages(batches, schema, lambda blocks: {"blocks": _hashes(blocks), "open": [k for k, (_, kind) in enumerate(blocks) if kind == OPEN]})


def _texts(batches):
    """The blocks that may stay, and the place of each that is open (-1 for the others)."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("content", pa.binary())]
        + [("texts", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))]
    )

    def more(blocks):
        stay = [(t, k if kind == OPEN else -1) for k, (t, kind) in enumerate(blocks) if kind != DROPPED]
        return {"texts": [t for t, _ in stay], "places": [k for _, k in stay]}

    return _pages(batches, schema, more)


def _nearest(path: str, before: dict | None, after: dict | None) -> dict | None:
    def alike(other: dict | None) -> int:
        if other is None:
            return -1
        n = 0
        for x, y in zip(path, other["path"]):
            if x != y:
                break
            n += 1
        return n

    return before if alike(before) >= alike(after) and before else after


def _differ(batches):
    """Places of the open blocks that the nearest page has too, of the pages with any."""
    schema = pa.schema([("key", pa.binary()), ("gone", pa.list_(pa.int32()))])
    for batch in batches:
        got = {c: [] for c in schema.names}
        for row in batch.to_pylist():
            other = _nearest(row["path"], row["before"], row["after"])
            shared = set(common(row["blocks"], other["blocks"])) if other else set()
            gone = [k for k in row["open"] if k in shared]
            if gone:
                got["key"].append(row["key"])
                got["gone"].append(gone)
        yield flat.rows(schema, **got)


#: Rows that agree in these are one page: copies are no neighbours of each other.
SAME = ("host", "content")


def _key() -> Column:
    return F.unhex(F.sha2(F.to_json(F.struct(*[F.hex(c) if c == "content" else F.col(c) for c in SAME])).cast("binary"), 256)).alias("key")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select("page_id", "url", "html")
    kinds = "page_id long, url string, host string, path string, content binary, blocks array<long>, open array<int>"
    cut = saved(pages.mapInArrow(_cut, kinds), "blocks").filter(F.size("blocks") > 0)
    one = cut.groupBy(_key()).agg(F.min(F.struct("host", "path", "url", "page_id", "blocks", "open")).alias("page")).select("key", "page.*")
    ordered = one.repartitionByRange("host", "path", "url", "page_id").sortWithinPartitions("host", "path", "url", "page_id")
    ordered = ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    ordered = saved(ordered, "ordered")

    bounds = ordered.groupBy("part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    bounds = bounds.withColumn("ended", F.expr("lag(last) over (order by part)")).select("first", "ended")  # a row per partition
    linked = ordered.select("at", "host", "path", "blocks").join(bounds, F.col("at") == F.col("first"), "left")
    linked = linked.withColumn("previous", F.when(F.col("first").isNotNull(), F.col("ended")).otherwise(F.col("at") - 1))
    linked = linked.select("at", "previous", F.struct("host", "path", "blocks").alias("page"))

    todo = ordered.select("key", "host", "path", "blocks", "open", "at")
    own = linked.select(F.col("at").alias("own_at"), F.col("previous").alias("own_previous"))
    todo = todo.join(own, F.col("at") == F.col("own_at"))
    before = linked.select(F.col("at").alias("before_at"), F.col("page").alias("before"))
    after = linked.select(F.col("previous").alias("after_of"), F.col("page").alias("after"))
    todo = todo.join(before, F.col("own_previous") == F.col("before_at"), "left").join(after, F.col("at") == F.col("after_of"), "left")
    here = lambda c: F.when(F.col(c)["host"].eqNullSafe(F.col("host")), F.col(c)).alias(c)
    told = todo.select("key", "path", "blocks", "open", here("before"), here("after"))
    told = saved(told.mapInArrow(_differ, "key binary, gone array<int>"), "gone").withColumnRenamed("key", "of_key")

    texts = pages.mapInArrow(_texts, "page_id long, url string, host string, content binary, texts array<string>, places array<int>")
    texts = texts.withColumn("key", _key()).join(told, F.col("key") == F.col("of_key"), "left")
    stay = F.filter("texts", lambda t, k: ~F.array_contains("gone", F.get("places", k)))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("texts")).otherwise(stay), " ")
    return texts.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
