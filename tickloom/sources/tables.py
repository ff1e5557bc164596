"""Partitioned tables: idempotent writes, range scans, manifests, capture lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import plus_seconds
from tickloom.functions.identity import row_hash
from tickloom.schemas import CAPTURE


class WriteConflict(ValueError):
    pass


def classify_write(existing: DataFrame, incoming: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Each incoming row as ``new``, ``same`` or ``conflict`` against what is stored.

    Copies inside the incoming rows are compared too: the same key with two payloads is a
    conflict even when nothing is stored yet.
    """
    new = incoming.withColumn("_h", row_hash(*payload)).groupBy(*key).agg(
        F.min_by(F.struct(*payload), "_h").alias("_row"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi")
    )
    old = existing.select(*key, row_hash(*payload).alias("_old"))
    both = new.join(old, list(key), "left")
    state = (
        F.when(F.col("_lo") != F.col("_hi"), "conflict").when(F.col("_old").isNull(), "new")
        .when(F.col("_old") == F.col("_lo"), "same").otherwise("conflict")
    )
    return both.select(*key, *[F.col(f"_row.{c}").alias(c) for c in payload], state.alias("write_state"))


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def append_new(
    spark: SparkSession, path: str, incoming: DataFrame, key: Sequence[str], payload: Sequence[str],
    partition_by: Sequence[str] = (),
) -> None:
    """Append unseen keys; repeat writes are no-ops; a changed payload is an error."""
    # Only a missing folder means that nothing is stored; any other error must stop the write.
    stored = spark.read.schema(incoming.schema)
    existing = stored.parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], incoming.schema)
    judged = classify_write(existing, incoming, key, payload)
    if not judged.where(F.col("write_state") == "conflict").isEmpty():
        raise WriteConflict(f"stored rows differ from incoming rows at {path}")
    fresh = judged.where(F.col("write_state") == "new").select(*incoming.columns)
    fresh.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_by_month(rows: DataFrame, path: str, time: str = "event_time", extra: Sequence[str] = ("instrument",)) -> None:
    """Layout for range scans: one folder per instrument and month, sorted inside by time."""
    from tickloom.session import shuffle_width

    months = rows.withColumn("month", F.date_format(time, "yyyy-MM"))
    placed = months.repartitionByRange(shuffle_width(rows.sparkSession), *extra, "month", time)
    placed.sortWithinPartitions(*extra, "month", time).write.mode("overwrite").partitionBy(*extra, "month").parquet(path)


def range_scan(table: DataFrame, start: str, end: str, time: str = "event_time") -> DataFrame:
    """Half-open [start, end): prunes month folders and pushes the time bounds to Parquet."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    out = table.where((F.col(time) >= lo) & (F.col(time) < hi))
    if "month" in table.columns:
        out = out.where((F.col("month") >= start[:7]) & (F.col("month") <= end[:7]))
    return out


def overlap_backfill(stored: DataFrame, fetched: DataFrame, key: Sequence[str], *, time: str, overlap_seconds: float, by: Sequence[str]) -> DataFrame:
    """Fetched rows from ``overlap`` before the newest stored one on, without the known keys."""
    cursor = stored.groupBy(*by).agg(F.max(time).alias("_cursor"))
    recent = fetched.join(cursor, list(by), "left").where(
        F.col("_cursor").isNull() | (F.col(time) >= plus_seconds("_cursor", -overlap_seconds))
    )
    return recent.drop("_cursor").join(stored.select(*key), list(key), "left_anti")


def observed_partitions(rows: DataFrame, time: str) -> DataFrame:
    return rows.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("observed_rows"), F.min(time).alias("observed_first"), F.max(time).alias("observed_last")
    )


def verify_manifest(observed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Declared against observed months, with the month adjacency of the manifest.

    ``manifest``: month, declared_rows, declared_first, declared_last. Both sides are one
    row per month.
    """
    m = manifest.withColumn("_prev", F.lag("month").over(Window.orderBy("month")))
    m = m.withColumn("_prev_last", F.lag("declared_last").over(Window.orderBy("month")))
    both = m.join(observed, "month", "full_outer")
    following = F.date_format(F.add_months(F.to_date(F.concat("_prev", F.lit("-01"))), 1), "yyyy-MM")
    pairs = [
        ("partition_missing", F.col("observed_rows").isNull()),
        ("partition_undeclared", F.col("declared_rows").isNull()),
        ("count_mismatch", F.col("observed_rows") != F.col("declared_rows")),
        ("first_mismatch", F.col("observed_first") != F.col("declared_first")),
        ("last_mismatch", F.col("observed_last") != F.col("declared_last")),
        ("month_not_adjacent", F.col("_prev").isNotNull() & (F.col("month") != following)),
        ("coverage_overlap", F.col("declared_first") <= F.col("_prev_last")),
    ]
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for code, c in pairs]))
    return both.select("month", "declared_rows", "observed_rows", issues.alias("issues"))


def requested_range_issues(observed: DataFrame, start: str, end: str) -> DataFrame:
    total = observed.agg(
        F.min("observed_first").alias("first"), F.max("observed_last").alias("last"), F.sum("observed_rows").alias("rows")
    )
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return total.withColumn("issues", F.array_compact(F.array(
        F.when(F.col("first") > lo, "starts_after_request"), F.when(F.col("last") < hi, "ends_before_request"),
    )))


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Raw capture lines into envelopes; unreadable lines keep their text in ``_corrupt``."""
    schema = T.StructType([*CAPTURE.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def stream_capture(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CAPTURE).json(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)
