"""What one micro-batch leaves to the next: keyed rows, pools of rows that wait, and published versions.

All of it is plain Parquet under the job's folder, written by ``batch`` number with overwrite, so a batch that is
repeated after a failure replaces what it wrote and reads what it read before.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """The last row of every key. A batch writes the rows it changed; every ``every`` batches all rows are written.

    So a batch writes what changed and reads one whole table and at most ``every`` sets of changes, however long the
    job has run. Parts that no batch can need any more are emptied.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, every: int = 16):
        self.spark, self.folder, self.key, self.every = spark, folder, key, every
        self.schema = spark.createDataFrame([], schema).schema

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}={batch_id}"

    def before(self, batch_id: int) -> DataFrame:
        """The rows as they were when batch ``batch_id`` began."""
        whole = batch_id // self.every * self.every  # written by the batch before this one
        rows = self.spark.createDataFrame([], self.schema).withColumn("_batch", F.lit(-1))
        if whole:
            rows = rows.unionByName(self._read("whole", whole - 1))
        for b in range(whole, batch_id):
            rows = rows.unionByName(self._read("changed", b))
        rest = [c for c in self.schema.names if c != self.key]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
        return last.select(*[F.col(c if c == self.key else f"_row.{c}").alias(c) for c in self.schema.names])

    def now(self) -> DataFrame:
        """The rows after the last batch that was written; found by the names of the files, none is read for it."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.folder).select("path")
        batches = files.agg(F.max(F.regexp_extract("path", r"changed=(\d+)", 1).try_cast("bigint")))
        return self.before(1 + batches.first()[0])

    def _read(self, kind: str, b: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._path(kind, b)).withColumn("_batch", F.lit(b))

    def put(self, batch_id: int, changed: DataFrame) -> DataFrame:
        """Keep the rows that batch ``batch_id`` changed, one a key, and give them back as written."""
        path = self._path("changed", batch_id)
        changed.select(*self.schema.names).write.mode("overwrite").parquet(path)
        if (batch_id + 1) % self.every == 0:
            # The changes up to here are all in the next whole table.
            whole = batch_id + 1 - self.every
            rows = self.before(batch_id).join(self._read("changed", batch_id), self.key, "left_anti")
            rows = rows.unionByName(self._read("changed", batch_id).drop("_batch"))
            rows.write.mode("overwrite").parquet(self._path("whole", batch_id))
            self._emptied("whole", whole - 1 - self.every)
            for b in range(whole - self.every, whole):
                self._emptied("changed", b)
        return self.spark.read.schema(self.schema).parquet(path)

    def _emptied(self, kind: str, batch_id: int) -> None:
        if batch_id >= 0:
            self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self._path(kind, batch_id))


class Pool:
    """Rows that wait until there are ``least`` of them, or until none has come for ``idle_s`` seconds.

    Each batch writes its rows and one line of a manifest: how many rows wait, since which batch, and which group, if
    any, was given out. Groups are numbered and each row is in exactly one; only a group that was closed for idleness
    may be smaller. A group counts once its line is in the manifest, so readers see whole groups or nothing.
    """

    LINE = "batch bigint, waits_from bigint, gave_from bigint, waiting bigint, at double, group bigint, rows bigint"

    def __init__(
        self, spark: SparkSession, folder: str, schema, least: int, idle_s: float, give: Callable[[DataFrame, int, int], None],
        clock: Callable[[], float] = time.time,
    ):
        self.spark, self.folder, self.least, self.idle_s, self.give, self.clock = spark, folder, least, idle_s, give, clock
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    def _line(self, batch_id: int) -> dict:
        """The manifest as batch ``batch_id`` left it."""
        if batch_id < 0:
            return {"batch": -1, "waits_from": 0, "gave_from": 0, "waiting": 0, "at": 0.0, "group": -1, "rows": 0}
        row = self.spark.read.schema(self.LINE).parquet(f"{self.folder}/manifest/line={batch_id}").first()
        return row.asDict()

    def _put_line(self, name: int, line: dict) -> None:
        frame = self.spark.createDataFrame([tuple(line.values())], self.LINE).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.folder}/manifest/line={name}")

    def _waiting(self, first: int, last: int) -> DataFrame:
        paths = [f"{self.folder}/rows/batch={b}" for b in range(first, last + 1)]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Take the rows of a batch, and give out what waits if that is enough, or if it had waited idle before."""
        before, now = self._line(batch_id - 1), self.clock()
        path = f"{self.folder}/rows/batch={batch_id}"
        rows.select(*self.schema.names).write.mode("overwrite").parquet(path)
        n = self.spark.read.schema(self.schema).parquet(path).count()
        line = before | {"batch": batch_id, "waiting": before["waiting"] + n, "rows": 0}
        idle = before["waiting"] and now - before["at"] > self.idle_s
        if line["waiting"] >= self.least or idle:
            line = self._given(line, batch_id)
        self._put_line(batch_id, line | {"at": now if n else before["at"]})
        if before["rows"]:  # the group that the batch before gave out is whole: its rows are needed no more
            for b in range(before["gave_from"], before["waits_from"]):
                self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={b}")

    def _given(self, line: dict, batch_id: int) -> dict:
        line = line | {"group": line["group"] + 1, "rows": line["waiting"]}
        self.give(self._waiting(line["waits_from"], batch_id), line["group"], line["rows"])
        return line | {"waits_from": batch_id + 1, "gave_from": line["waits_from"], "waiting": 0}

    def close_idle(self, last_batch: int, now: float | None = None) -> bool:
        """Give out what waits after ``last_batch`` if nothing has come for long; for a timer, or at the end."""
        line = self._line(last_batch)
        if not line["waiting"] or (self.clock() if now is None else now) - line["at"] <= self.idle_s:
            return False
        self._put_line(last_batch, self._given(line, last_batch))
        return True

    def groups(self) -> DataFrame:
        """The manifest of the groups given out: group, rows."""
        lines = self.spark.read.schema(self.LINE + ", line bigint").parquet(f"{self.folder}/manifest")
        return lines.filter("rows > 0").select("group", "rows")


class Registry:
    """Versions of something that takes several files, under one folder, with a table of pointers.

    A version is written to a folder of its own and can be seen once its pointer is written, in one file; so readers
    get a whole version, and what they read is never changed.
    """

    POINTER = "version bigint, path string, at double, metrics map<string,double>"

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder, clock
        spark.createDataFrame([], self.POINTER).coalesce(1).write.mode("append").parquet(f"{folder}/pointers")

    def pointers(self) -> DataFrame:
        return self.spark.read.schema(self.POINTER).parquet(f"{self.folder}/pointers")

    def publish(
        self, write: Callable[[str], None], metrics: dict[str, float] | Callable[[str], dict[str, float]] | None = None
    ) -> int:
        """Write a new version by ``write(path)`` and point to it; its number. ``metrics`` may be measured on what was
        written, before anything points to it."""
        version = 1 + (self.pointers().agg(F.max("version")).first()[0] or 0)
        path = f"{self.folder}/version={version}-{uuid.uuid4().hex}"
        write(path)
        known = metrics(path) if callable(metrics) else metrics or {}
        line = [(version, path, float(self.clock()), {k: float(v) for k, v in known.items()})]
        self.spark.createDataFrame(line, self.POINTER).coalesce(1).write.mode("append").parquet(f"{self.folder}/pointers")
        return version

    def latest(self) -> str | None:
        """Path of the newest version."""
        row = self.pointers().orderBy(F.desc("version")).first()
        return row["path"] if row else None

    def best(self, metric: str) -> str | None:
        """Path of the version with the least value of ``metric``, the newest of equals; versions without it do not count."""
        value = F.col("metrics")[metric]
        row = self.pointers().filter(value.isNotNull() & ~F.isnan(value)).orderBy(value, F.desc("version")).first()
        return row["path"] if row else None
