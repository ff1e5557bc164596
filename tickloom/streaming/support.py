"""Tables written per micro-batch, guarded checkpoints and stream running."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond the heap; required by arbitrary stateful processing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class BatchTable:
    """A table with one folder per micro-batch.

    A micro-batch that is run again after a failure overwrites its own folder, so the
    table never holds a batch twice.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self, before: int | None = None, only: int | None = None) -> DataFrame:
        """All batches, those before a batch number, or one; empty when nothing is there."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        rows = self.spark.read.schema(full).parquet(self.path)
        if before is not None:
            rows = rows.where(F.col("batch_id") < before)
        if only is not None:
            rows = rows.where(F.col("batch_id") == only)
        return rows.drop("batch_id")


class ConfigMismatch(ValueError):
    pass


def guard_checkpoint(spark: SparkSession, path: str, config: dict) -> str:
    """Checkpoint folder bound to a configuration; another configuration is refused."""
    identity = sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    mark = f"{path}/config_identity"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(mark)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        stored = spark.read.text(mark).first()[0]
        if stored != identity:
            raise ConfigMismatch("the checkpoint was written under another configuration")
    else:
        spark.createDataFrame([(identity,)], "value string").coalesce(1).write.text(mark)
    return f"{path}/checkpoint"


def run_available(stream: DataFrame, checkpoint: str, *, sink: str | None = None, each=None, mode: str = "append", timeout: int | None = None) -> None:
    """Process what is there now and stop; to a Parquet sink or a per-batch function. ``timeout`` (seconds) is for tests."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each is not None else writer.format("parquet").start(sink)
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError("the stream did not finish in time")
    finally:
        query.stop()
