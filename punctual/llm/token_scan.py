"""Token counts from flat token files without an index, by a scan for the separator.

A flat file is nothing but token numbers, two or four bytes each, with an end-of-document number after every document.
It is read in blocks. Each block finds its separators in one vectorised comparison and reports how many there are, the
lengths between them, and the tokens before the first and after the last. A prefix scan over the reports (sums within
groups of blocks, then over the groups, then back) numbers the documents and carries the open length into the next
block, so a document may span any number of blocks.

Defined cases: two separators in a row are an empty document; tokens after the last separator are a last document
without end; an empty file has no document; a null text is tokenised as an empty one; repeated rows are documents of
their own; a text may be longer than a block.
"""

from __future__ import annotations

import base64
import importlib.util
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctual.llm.tables import saved

#: Tokens of a block, and blocks of a group of the prefix scan.
BLOCK, GROUP = 1 << 19, 4096


def tokeniser(folder: str, name: str):
    """A byte-pair encoder from a rank file in ``folder``, with the pattern stated beside it."""
    import tiktoken

    if "_vocabulary_notes" not in sys.modules:
        spec = importlib.util.spec_from_file_location("_vocabulary_notes", f"{folder}/__init__.py")
        sys.modules["_vocabulary_notes"] = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(sys.modules["_vocabulary_notes"])
    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=sys.modules["_vocabulary_notes"].PATTERN, mergeable_ranks=ranks, special_tokens={})


def _written(folder: str, name: str, eod: int, width: str, block: int):
    """Blocks of the flat file that a task writes (file, at, tokens) and the order of its documents (file, doc, doc_id)."""

    def run(batches):
        schema = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("tokens", pa.binary()), ("doc", pa.int64()), ("doc_id", pa.int64())])
        encoder, left, at, doc, file = None, np.zeros(0, width), 0, 0, None

        def put(tokens: np.ndarray, at: int):
            return flat_rows(schema, file=[file], at=[at], tokens=pa.array([tokens.tobytes()], pa.binary()), doc=pa.nulls(1, pa.int64()), doc_id=pa.nulls(1, pa.int64()))

        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or tokeniser(folder, name)
            file = batch.column("part")[0].as_py() if file is None else file
            m = batch.num_rows
            yield flat_rows(schema, file=np.full(m, file), at=pa.nulls(m, pa.int64()), tokens=pa.nulls(m, pa.binary()), doc=np.arange(doc, doc + m), doc_id=batch.column("doc_id"))
            doc += m
            parts = [left]
            for text in batch.column("text"):
                parts += [np.array(encoder.encode_ordinary(text.as_py() or ""), width), np.array([eod], width)]
                if sum(map(len, parts)) >= block:
                    left = np.concatenate(parts)
                    while len(left) >= block:
                        yield put(left[:block], at)
                        left, at = left[block:], at + 1
                    parts = [left]
            left = np.concatenate(parts)
        if len(left):
            yield put(left, at)

    return run


def flat_rows(schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in schema for c in [columns[f.name]]], schema=schema)


def token_blocks(spark: SparkSession, path: str, width: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, at, tokens) of the flat files in ``path``: one file a row at first, so files stay below two gigabytes."""

    def run(batches):
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("tokens", pa.binary())])
        step = block * np.dtype(width).itemsize
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = data.as_py()
                for at in range(0, len(data), step):
                    yield flat_rows(schema, file=[name], at=[at // step], tokens=pa.array([data[at : at + step]], pa.binary()))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, at long, tokens binary")


def _scan(eod: int, width: str):
    def run(batches):
        schema = pa.schema([("at", pa.int64()), ("ends", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))])
        for batch in batches:
            got = {c: [] for c in ("ends", "head", "tail", "inner")}
            for blob in batch.column("tokens").to_pylist():
                tokens = np.frombuffer(blob, width)
                ends = np.flatnonzero(tokens == eod)
                got["ends"].append(len(ends))
                got["head"].append(int(ends[0]) if len(ends) else len(tokens))
                got["tail"].append(len(tokens) - int(ends[-1]) - 1 if len(ends) else len(tokens))
                got["inner"].append((np.diff(ends) - 1).tolist())
            told = flat_rows(schema, at=batch.column("at"), **got)
            yield pa.RecordBatch.from_arrays([batch.column("file"), *told.columns], ["file", *schema.names])

    return run


def count_tokens(blocks: DataFrame, eod: int, width: str = "<u2", group: int = GROUP) -> DataFrame:
    """(file, doc, n_tokens): documents by file and place, from ``blocks`` (file, at, tokens)."""
    kind = dict(blocks.dtypes)["file"]
    told = blocks.select("file", "at", "tokens").mapInArrow(_scan(eod, width), f"file {kind}, at long, ends long, head long, tail long, inner array<long>")
    told = saved(told.withColumn("group", F.floor(F.col("at") / group)), "scanned")

    # A block with a separator starts a new open length with its tail; one without adds to what is open.
    # Sums up to the last separator are taken off: open = tokens since it.
    inside = Window.partitionBy("file", "group").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    one = F.max(F.when(F.col("ends") > 0, F.col("at"))).over(inside)
    rows = told.withColumn("ended", one).withColumn("docs", F.coalesce(F.sum("ends").over(inside), F.lit(0)))
    rows = rows.withColumn("sum", F.coalesce(F.sum("tail").over(inside), F.lit(0)))
    rows = rows.withColumn("sum_with", F.when(F.col("ends") > 0, F.col("sum"))).withColumn("base", F.coalesce(F.max("sum_with").over(inside), F.lit(0)))
    rows = rows.drop("sum_with").withColumn("open", F.col("sum") - F.col("base"))

    ends = F.max(F.when(F.col("ends") > 0, F.struct("at", "tail"))).alias("last")
    groups = told.groupBy("file", "group").agg(F.sum("ends").alias("ends"), F.max("at").alias("to"), ends, F.sum("tail").alias("all_tails"))
    after = told.join(groups.select("file", "group", F.col("last.at").alias("last_at")), ["file", "group"])
    after = after.filter("last_at is null or at >= last_at").groupBy("file", "group").agg(F.sum("tail").alias("left"))
    groups = groups.select("file", "group", "ends").join(after, ["file", "group"])
    over = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("group_docs", F.coalesce(F.sum("ends").over(over), F.lit(0)))
    groups = groups.withColumn("total", F.coalesce(F.sum("left").over(over), F.lit(0)))
    # ``left`` of a group with a separator replaces what was open before it.
    groups = groups.withColumn("mark", F.when(F.col("ends") > 0, F.col("total"))).withColumn("mark", F.coalesce(F.max("mark").over(over), F.lit(0)))
    groups = groups.select("file", "group", "group_docs", (F.col("total") - F.col("mark")).alias("group_open"))
    rows = rows.join(groups, ["file", "group"])
    opened = F.col("open") + F.when(F.col("ended").isNull(), F.col("group_open")).otherwise(0)
    first = F.when(F.col("ends") > 0, F.array(opened + F.col("head"))).otherwise(F.array().cast("array<long>"))
    place = F.col("group_docs") + F.col("docs")
    complete = rows.select("file", place.alias("place"), F.posexplode(F.concat(first, "inner")).alias("k", "n_tokens"))
    complete = complete.select("file", (F.col("place") + F.col("k")).alias("doc"), "n_tokens")
    last = told.groupBy("file").agg(F.max("at").alias("at"))
    rest = rows.join(last, ["file", "at"]).select(
        "file", (place + F.col("ends")).alias("doc"), (F.col("tail") + F.when(F.col("ends") > 0, 0).otherwise(opened)).alias("n_tokens")
    )
    return complete.unionByName(rest.filter("n_tokens > 0"))


def tokenised(docs: DataFrame, folder: str, name: str, eod: int, width: str = "<u2", block: int = BLOCK) -> DataFrame:
    """The documents as flat token files in blocks, written: (file, at, tokens), and in other rows (file, doc, doc_id)."""
    rows = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    return saved(rows.mapInArrow(_written(folder, name, eod, width, block), "file long, at long, tokens binary, doc long, doc_id long"), "tokens")


def document_lengths(docs: DataFrame, folder: str, name: str = "byte_bpe_50k.tiktoken", eod: int = 50256, width: str = "<u2", block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens (its end not counted) of every document, by a scan of its flat token file."""
    written = tokenised(docs, folder, name, eod, width, block)
    counts = count_tokens(written.filter("tokens is not null").select("file", "at", "tokens"), eod, width)
    order = written.filter("doc is not null").select("file", "doc", "doc_id")
    return order.join(counts, ["file", "doc"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
