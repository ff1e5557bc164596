"""Numbered commits of a table: who writes number n first has it, so two writers cannot both append a key.

A table is a folder of data folders and a log of small JSON files, one per commit. A commit is a rename of a finished file to
its number, which fails when the number is taken; readers see the data that commits name and nothing else. Data
of a writer that lost or died is never named.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.tables import WriteConflict, classify_write


class CommitLog:
    """Commits 0, 1, 2, ... under ``path``; each holds a small JSON object."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/_commits"
        self._conf = spark._jsc.hadoopConfiguration()

    def _hadoop(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def latest(self) -> int:
        """The newest commit, -1 before the first."""
        folder = self._hadoop()
        fs = folder.getFileSystem(self._conf)
        if not fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def read(self, number: int) -> dict:
        file = self._hadoop(f"{number:012d}.json")
        stream = file.getFileSystem(self._conf).open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, content: Mapping) -> bool:
        """Whether this writer got the number; False when another one has it."""
        draft, final = self._hadoop(f".{uuid.uuid4().hex}"), self._hadoop(f"{number:012d}.json")
        fs = draft.getFileSystem(self._conf)
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, none)
        except Exception:
            fs.delete(draft, False)
            if not fs.exists(final):
                raise
            return False
        return True


def _read(spark: SparkSession, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


class AppendTable:
    """Rows appended once per key. A commit names one data folder; a repeated write adds nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], log: CommitLog | None = None):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, list(key)
        self.log = log or CommitLog(spark, path)

    def rows(self, since: int = 0, upto: int | None = None) -> DataFrame:
        """Rows of the commits ``since`` to ``upto`` (the newest by default)."""
        last = self.log.latest() if upto is None else upto
        return _read(self.spark, [self.log.read(n)["folder"] for n in range(since, last + 1)], self.schema)

    def append(self, incoming: DataFrame) -> int:
        """Add the keys that are not stored; the number of rows added.

        A key that is stored with another payload, or comes with two, is a ``WriteConflict`` and nothing is added. When
        another writer commits meanwhile, what is left of the rows is held against that commit and tried again.
        """
        payload = [c for c in self.schema.fieldNames() if c not in self.key]
        base, seen = self.log.latest(), 0
        fresh = incoming.select(*self.schema.fieldNames())
        while True:
            judged = classify_write(self.rows(seen, base), fresh, self.key, payload)
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            judged.write.parquet(folder)
            stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("write_state", T.StringType())])).parquet(folder)
            states = {r["write_state"]: r["count"] for r in stored.groupBy("write_state").count().collect()}
            if states.get("conflict"):
                raise WriteConflict(f"stored rows differ from incoming rows at {self.path}")
            fresh = stored.where("write_state = 'new'").select(*self.schema.fieldNames())
            if not states.get("new"):
                return 0
            own = folder
            if states.get("same"):
                own = f"{self.path}/data/{uuid.uuid4().hex}"
                fresh.write.parquet(own)
            if self.log.commit(base + 1, {"folder": own, "rows": states["new"]}):
                return states["new"]
            seen, base = base + 1, self.log.latest()


class SnapshotTable:
    """Rows by partition, replaced partition by partition: a commit names the current folder of every partition.

    A merge writes new folders for the partitions that it touches and then the commit; a reader sees the table before or after it. ``keys``
    are unique; of several rows the one with the greatest ``rank`` stays.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], partition: F.Column, rank: F.Column):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.partition, self.rank, self.log = partition.cast("string"), rank, CommitLog(spark, path)

    def _state(self) -> tuple[int, dict]:
        last = self.log.latest()
        return last, (self.log.read(last) if last >= 0 else {"parts": {}, "batch": -1})

    def read(self) -> DataFrame:
        """The whole table: one plain scan of the current folders."""
        return _read(self.spark, sorted(self._state()[1]["parts"].values()), self.schema)

    def merge(self, rows: DataFrame, batch_id: int) -> bool:
        """Merge a micro-batch; False when it had been merged before. One writer at a time: a second one is an error."""
        last, state = self._state()
        if batch_id <= state["batch"]:
            return False
        rows = rows.select(*self.schema.fieldNames()).withColumn("_part", F.coalesce(self.partition, F.lit("")))
        touched = [r["_part"] for r in rows.select("_part").distinct().collect()]  # partition names, not rows
        before = [state["parts"][p] for p in touched if p in state["parts"]]
        stored = _read(self.spark, before, self.schema).withColumn("_part", F.coalesce(self.partition, F.lit("")))
        rest = [c for c in self.schema.fieldNames() if c not in self.keys]
        best = stored.unionByName(rows).groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "_part"), self.rank).alias("_r"))
        merged = best.select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest], F.col("_r._part").alias("_part"))
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        merged.select(*self.schema.fieldNames(), "_part").write.partitionBy("_part").parquet(folder)
        names = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = names.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(names)
        fresh = {s.getPath().getName(): s.getPath().toString() for s in found if s.isDirectory()}
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        parts = state["parts"] | {p: fresh[f"_part={escape(p) if p else '__HIVE_DEFAULT_PARTITION__'}"] for p in touched}
        if not self.log.commit(last + 1, {"parts": parts, "batch": batch_id}):
            raise WriteConflict(f"another writer merged into {self.path}")
        return True
