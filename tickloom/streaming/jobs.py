"""Per-batch jobs over tables: signals on closed bars, and the quote book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.quality import freshness
from tickloom.operators.book import quote_book
from tickloom.operators.signals import as_signals, donchian
from tickloom.streaming.support import BatchTable

SIGNAL = T.StructType([
    T.StructField("signal_id", T.StringType()), T.StructField("instrument", T.StringType()),
    T.StructField("direction", T.StringType()), T.StructField("detected_at", T.TimestampType()),
    T.StructField("strategy", T.StringType()),
])

class SignalJob:
    """Channel-breakout signals for the bars of each micro-batch.

    Of the stored bars only the last ``lookback`` of each series are needed. Batches below
    ``emit_from`` warm the tables up without emitting.
    """

    def __init__(self, spark: SparkSession, path: str, bar_schema: T.StructType, *, lookback: int = 20, emit_from: int = 0):
        self.lookback, self.emit_from = lookback, emit_from
        self.bars = BatchTable(spark, f"{path}/bars", bar_schema)
        self.signals = BatchTable(spark, f"{path}/signals", SIGNAL)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        keys = ["instrument", "tf_seconds", "start"]
        known = self.bars.read(before=batch_id)
        fresh = batch.join(known.select(*keys), keys, "left_anti")
        series = ["instrument", "tf_seconds"]
        first = fresh.groupBy(*series).agg(F.min("start").alias("_first"))
        older = known.join(first, series).where(F.col("start") < F.col("_first"))
        newest = Window.partitionBy(*series).orderBy(F.desc("start"))
        tail = older.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= self.lookback).drop("_back")
        both = tail.drop("_first").unionByName(fresh)
        rows = donchian(both, self.lookback).join(fresh.select(*keys), keys, "left_semi")
        found = as_signals(rows, "donchian20").select(*SIGNAL.fieldNames())
        self.signals.write(found if batch_id >= self.emit_from else found.limit(0), batch_id)
        self.bars.write(fresh, batch_id)


BOOK = T.StructType([
    T.StructField("instrument", T.StringType()), T.StructField("arrival", T.LongType()), T.StructField("bid", T.DoubleType()),
    T.StructField("ask", T.DoubleType()), T.StructField("bid_us", T.LongType()), T.StructField("ask_us", T.LongType()),
    T.StructField("status", T.StringType()),
])


class BookJob:
    """Two-sided book over micro-batches of one-sided updates.

    The held book per instrument is kept as a small table; inside a batch the updates are
    folded range by range in parallel, so a burst of one instrument is not one task's work.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.book = BatchTable(spark, f"{path}/book", BOOK)
        self.held = BatchTable(spark, f"{path}/held", BOOK)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != "instrument"]
        top = rows.groupBy("instrument").agg(F.max_by(F.struct(*rest), "arrival").alias("_r"))
        return top.select("instrument", "_r.*")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self._newest(self.held.read(before=batch_id))
        rows = quote_book(batch, ["instrument"], "arrival", before)
        self.book.write(rows, batch_id)
        self.held.write(self._newest(rows), batch_id)


def status_snapshot(bars: DataFrame, now, *, max_feed_age: float, max_bar_age: float) -> DataFrame:
    """Freshness per instrument over the latest stored rows."""
    return freshness(
        bars.withColumn("_now", now), "_now", keys=["instrument", "_now"], received="available_at", bar_end="end", closed="closed",
        max_feed_age=max_feed_age, max_bar_age=max_bar_age,
    ).drop("_now")
