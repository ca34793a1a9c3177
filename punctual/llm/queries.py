"""The named queries of this package over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import ball_codes, bpe, conversation_trie, decontamination, factorisation, minhash, mixing, page_difference, ppm, pseudonyms, quality_rules, suffixes, token_scan
from punctual.llm.tables import table

#: Where the vocabularies of public tokenisers lie.
VOCABULARIES = "/opt/tokenizers"
#: Bytes of context of the language model: longer ones ask for several times as much and score no better.
CONTEXT = 4


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.drop("text_key")


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_lengths(table(spark, sf_dir, "documents"), VOCABULARIES)


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, pseudonyms.EXAMPLE_KEY)


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *measures, "base_failed", "kept")


def op8_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_difference.extract(table(spark, sf_dir, "pages"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), order=CONTEXT, by_word=False)


def op10_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = ball_codes.codes(table(spark, sf_dir, "embeddings"))
    told = ball_codes.with_label_errors(coded.select("vec_id", "label", "code", "error"))
    return told.select(
        "vec_id", ball_codes.code_text().alias("code"), "error", "label_error", F.lit(ball_codes.books_digest(books)).alias("codebooks_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("ref")


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_50k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cube_mixing": op1_cube_mixing,
    "op2_factorisation_machine": op2_factorisation_machine,
    "op3_prefix_join": op3_prefix_join,
    "op4_separator_scan": op4_separator_scan,
    "op5_bbit_minhash": op5_bbit_minhash,
    "op6_host_rules": op6_host_rules,
    "op7_feistel_pseudonyms": op7_feistel_pseudonyms,
    "op8_page_difference": op8_page_difference,
    "op9_ppm": op9_ppm,
    "op10_difference_cover": op10_difference_cover,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_prefix_bpe": op13_prefix_bpe,
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _nearest(k: int) -> str:
    """The nearest entry of every part in the codebooks after ``k`` rounds, the lower of equals."""
    return f"""near{k} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min(e) AS e, min(d) AS d FROM (
    SELECT *, min(d) OVER (PARTITION BY vec_id, p) AS least FROM (
      SELECT a.vec_id, a.label, a.p, a.x, b.e,
        list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) AS d
      FROM part a JOIN book{k} b ON a.p = b.p
    )
  ) WHERE d = least GROUP BY vec_id, label, p, x
)"""


def _moved(k: int) -> str:
    """The codebooks after one more round."""
    return f"""book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (
      SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY p, e, i
    ) GROUP BY p, e
  ) m ON b.p = m.p AND b.e = m.e
)"""


SQL: dict[str, str] = {
    "op3_prefix_join": rf"""
WITH item AS (
  SELECT item_id, {_RUNS} AS w FROM benchmark
), cut AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, w[p:p + 9] AS win FROM cut
), doc AS (
  SELECT doc_id, {_RUNS} AS w FROM documents
), sizes AS (
  SELECT DISTINCT len(win) AS n FROM windows
), placed AS (
  SELECT doc_id, n, p, w[p:p + n - 1] AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM doc, sizes WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, n, p, item_id FROM placed JOIN windows USING (win)
), word AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op5_bbit_minhash": rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, len(s) AS n FROM sets
), each AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS x FROM sets
), meet AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM meet JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * same >= 85 * (p.n + q.n - same)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
""",
    "op6_host_rules": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), base AS (
  SELECT doc_id, source, {_WORDS} AS words, string_split(text, chr(10)) AS lines,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM d
), line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(lines) AS l FROM base) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), word AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM base
), three AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS times FROM (
    SELECT doc_id, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY p)
  ) WHERE w3 IS NOT NULL
), repeated AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM three WHERE times > 1) GROUP BY doc_id
), measured AS (
  SELECT b.doc_id, b.source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, n_upper, n_lower
  FROM base b LEFT JOIN line USING (doc_id) LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST(n_words < 50 AS INT) + CAST(100 * n_repeat_words > 50 * n_words AS INT) + CAST(10 * n_symbols > n_words AS INT)
    + CAST(100 * n_dup_lines > 30 * n_lines AS INT)
    + CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INT) + CAST(n_upper > n_lower AS INT) AS failures
  FROM measured
), host AS (
  SELECT source, count(*) AS docs, count(*) FILTER (failures > 0) AS failed FROM judged GROUP BY source
), prior AS (
  SELECT least(greatest(avg(failed / docs), 0.001), 0.999) AS mean, var_pop(failed / docs) AS variance FROM host
), rate AS (
  SELECT source, CASE WHEN variance > 0
    THEN (failed + mean * greatest(mean * (1 - mean) / variance - 1, 2)) / (docs + greatest(mean * (1 - mean) / variance - 1, 2))
    ELSE mean END AS r
  FROM host, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (failures = 0 OR ln(r / (1 - r)) + 3 * failures < 0) AS kept
FROM judged j JOIN rate ON j.source IS NOT DISTINCT FROM rate.source
""",
    "op10_difference_cover": """
WITH d AS MATERIALIZED (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents
), strings AS MATERIALIZED (
  SELECT doc_id, s, md5(b[s:s + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS s FROM d)
), twice AS (
  SELECT doc_id, s FROM strings WHERE h IN (SELECT h FROM strings GROUP BY h HAVING count(*) > 1)
), numbered AS (
  SELECT doc_id, s, sum(CASE WHEN s - p <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM twice)
), runs AS (
  SELECT doc_id, run, min(s) AS a, max(s) + 399 AS z FROM numbered GROUP BY ALL
), cut AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
), kept AS (
  SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last,
    string_agg(hex(b[before + 1:a - 1]), '' ORDER BY a) AS pieces
  FROM cut JOIN d USING (doc_id) GROUP BY 1
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN last IS NULL THEN b ELSE unhex(pieces || hex(b[last + 1:n])) END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op11_ball_kmeans": f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS p FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, e - 1 AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM part) WHERE e <= 64
), {_nearest(0)}, {_moved(0)}, {_nearest(1)}, {_moved(1)}, {_nearest(2)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_id, label
), total AS (
  SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2
)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN total ON coded.label IS NOT DISTINCT FROM total.label, books
""",
    "op12_prefix_trie": """
WITH RECURSIVE crc_byte(byte, bit, crc) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT byte, bit + 1, CASE WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END FROM crc_byte WHERE bit < 8
), crc_table AS MATERIALIZED (
  SELECT byte, crc FROM crc_byte WHERE bit = 8
), ids AS MATERIALIZED (
  SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, pos, crc) AS (
  SELECT conv_id, 0, 4294967295 FROM ids
  UNION ALL
  SELECT c.conv_id, pos + 1, xor(c.crc // 256, t.crc)
  FROM crc c JOIN crc_table t ON t.byte = xor(c.crc, CAST(ascii(CAST(c.conv_id AS VARCHAR)[pos + 1]) AS BIGINT)) % 256
  WHERE pos < length(CAST(c.conv_id AS VARCHAR))
), head AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM crc WHERE pos = length(CAST(conv_id AS VARCHAR))
), turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM head h JOIN turns t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL
  SELECT h.conv_id, 1, t.pos, t.role, t.text FROM head h JOIN turns t ON t.conv_id = h.conv_id AND t.pos > h.h
), whole AS MATERIALIZED (
  SELECT conv_id, coalesce(path, []) AS path FROM ids LEFT JOIN (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, pos) AS path FROM rebuilt GROUP BY conv_id
  ) USING (conv_id)
), member AS MATERIALIZED (
  SELECT conv_id, depth, path[1:depth] AS node, depth = len(path) AS ends FROM (
    SELECT conv_id, path, CAST(unnest(range(len(path) + 1)) AS BIGINT) AS depth FROM whole
  )
), node AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM member GROUP BY node, depth
), child AS (
  SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT node[1:up] AS node, up AS depth, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(worth) AS BIGINT) AS saved_tokens FROM (
    SELECT n.node, unnest(range(n.depth + 1)) AS up, CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END AS leaf,
      CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.node[n.depth].text) END AS worth
    FROM node n LEFT JOIN child c ON n.depth = c.depth AND n.node = c.node
  ) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens,
  sha256(n.ids) AS ends_sha256
FROM node n JOIN below b ON n.depth = b.depth AND n.node = b.node
LEFT JOIN child c ON n.depth = c.depth AND n.node = c.node
LEFT JOIN node p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
""",
}
