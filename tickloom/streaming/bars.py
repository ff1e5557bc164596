"""Bars, duplicates and late rows on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import effective_available, interval_start, selected_price
from tickloom.functions.quality import merged_flags, tick_issues
from tickloom.operators.bars import order_key
from tickloom.operators.scan import range_chunks, run_max, running
from tickloom.sources.commits import SnapshotTable
from tickloom.streaming.support import BatchTable


def stream_bars(ticks: DataFrame, tf: int, delay: str = "10 minutes") -> DataFrame:
    """Closed bars of one timeframe, emitted when the watermark passes their end.

    Empty intervals give no bar. One query per timeframe, so larger and smaller bars close
    on their own.
    """
    rows = ticks.where(F.size(tick_issues()) == 0).withWatermark("event_time", delay)
    rows = rows.withColumns({"_price": selected_price(), "_avail": effective_available(), "_key": order_key()})
    bars = rows.groupBy("instrument", F.window("event_time", f"{tf} seconds").alias("w")).agg(
        F.min_by("_price", "_key").alias("open"), F.max("_price").alias("high"), F.min("_price").alias("low"),
        F.max_by("_price", "_key").alias("close"), F.sum(F.coalesce("quantity", F.lit(0.0))).alias("volume"),
        F.count(F.lit(1)).alias("event_count"), F.min("event_time").alias("first_event"),
        F.max("_avail").alias("known_at"), merged_flags("quality_flags").alias("quality_flags"),
    )
    return bars.select(
        "instrument", F.lit(tf).alias("tf_seconds"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high",
        "low", "close", "volume", "event_count", (F.col("first_event") > F.col("w.start")).alias("partial"),
        F.greatest("w.end", "known_at").alias("available_at"), "quality_flags",
    )


def sliding_bars(ticks: DataFrame, tf: int, slide: int, delay: str = "10 minutes") -> DataFrame:
    rows = ticks.withWatermark("event_time", delay)
    return rows.groupBy("instrument", F.window("event_time", f"{tf} seconds", f"{slide} seconds").alias("w")).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.count(F.lit(1)).alias("event_count")
    ).select("instrument", "w.start", "w.end", "high", "low", "event_count")


def activity_sessions(rows: DataFrame, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key's rows, closed after ``gap`` without any."""
    marked = rows.withWatermark("event_time", delay)
    return marked.groupBy(key, F.session_window("event_time", gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events"
    )


def first_seen(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per event id; the ids are kept only as long as the watermark allows copies."""
    return ticks.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


class LateRecorder:
    """Split of the arriving rows into those for open intervals and those that came too late.

    An interval is closed for a series once a row of a newer one has arrived before, in the order of ``arrival``. So a row's fate depends on the
    rows before it and not on how they fall into micro-batches. Late rows are kept with an issue code and never merged.
    Between micro-batches one row per series, its newest interval, is carried; inside one the rows are scanned by ranges.
    """

    def __init__(self, spark, path: str, tf: int, schema, arrival: Sequence[str] = ("arrival",)):
        self.tf, self.arrival = tf, list(arrival)
        progress = T.StructType([T.StructField("instrument", T.StringType()), T.StructField("newest", T.TimestampType())])
        late = T.StructType([*schema.fields, T.StructField("issue", T.StringType())])
        self.progress = BatchTable(spark, f"{path}/progress", progress)
        self.on_time = BatchTable(spark, f"{path}/on_time", schema)
        self.late = BatchTable(spark, f"{path}/late", late)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        carried = self.progress.read(only=batch_id - 1)
        order = range_chunks(batch.withColumn("_start", interval_start("event_time", self.tf)), ["instrument"], self.arrival)
        rows = running(order, ["instrument"], self.arrival, {"_seen": run_max("_start")}, inclusive=False).join(carried, "instrument", "left")
        late = F.coalesce(F.col("_start") < F.greatest("_seen", "newest"), F.lit(False))
        self.on_time.write(rows.where(~late), batch_id)
        self.late.write(rows.where(late).withColumn("issue", F.lit("late_closed_interval")), batch_id)
        newest = order.select("instrument", F.col("_start").alias("newest")).unionByName(carried)
        self.progress.write(newest.groupBy("instrument").agg(F.max("newest").alias("newest")), batch_id)


class NativePreferred:
    """Per-batch merge of bars from two origins: native above derived, copies ignored.

    Bars lie in one partition per month of their start; a delivery rewrites the months it has bars of, and a commit
    then switches readers over. A delivery that comes again changes nothing.
    """

    def __init__(self, spark, path: str, schema):
        rank = F.struct((F.col("origin") == "native").cast("int"), "available_at", "close")
        self.table = SnapshotTable(spark, path, schema, ["instrument", "tf_seconds", "start"], F.date_format("start", "yyyy-MM"), rank)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.table.merge(batch, batch_id)

    def current(self) -> DataFrame:
        return self.table.read()
