"""Deterministic ids and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_text(*cols: str | Column) -> Column:
    """Field-tagged text of the given columns; NULL differs from an empty string."""
    parts = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        text = c.cast("string")
        parts.append(F.when(text.isNull(), F.lit("~")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.concat_ws("|", *parts)


def row_hash(*cols: str | Column) -> Column:
    return F.sha2(canonical_text(*cols), 256)


def event_id(*cols: str | Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(row_hash(*cols), 1, 32))


def dataset_fingerprint(df: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Order-free content hash per key, in two levels.

    Row hashes are first combined inside a bucket chosen by the hash itself: two 32-bit
    slices are summed and counted, so a bucket of any size is one small running total.
    The bucket totals (at most ``buckets`` per key) are then hashed in bucket order.
    """
    hashed = df.withColumn("_h", row_hash(*df.columns))
    bucket = F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    piece = lambda at: F.conv(F.substring("_h", at, 8), 16, 10).cast("bigint")
    small = hashed.withColumn("_b", bucket).groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(piece(9)).alias("_s1"), F.sum(piece(17)).alias("_s2"),
        F.sum(piece(25)).alias("_s3"),
    )
    line = F.concat_ws(":", *[F.col(c).cast("string") for c in ("_b", "_n", "_s1", "_s2", "_s3")])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_b", line.alias("t")))), lambda s: s["t"])
    return small.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.sha2(F.concat_ws("|", ordered), 256).alias("fingerprint")
    )
