"""Duplicates, order evidence and source identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scan import neighbour, range_chunks, run_max, running


def first_wins(rows: DataFrame, ident: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per identity, the first in ``order``, with the number of copies dropped.

    An aggregation, not a sort: copies combine on the map side, so an identity repeated
    millions of times costs one partial row per task.
    """
    rest = [c for c in rows.columns if c not in ident]
    picked = rows.groupBy(*ident).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), (F.count(F.lit(1)) - 1).alias("duplicates")
    )
    return picked.select(*ident, *[F.col(f"_row.{c}").alias(c) for c in rest], "duplicates")


def merge_results(frames: Sequence[DataFrame], ident: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of result sets merged by identity; the earliest source wins."""
    from tickloom.operators.scan import union_all

    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    merged = first_wins(union_all(tagged), ident, ["_source", *order])
    return merged.drop("_source", "duplicates")


def out_of_order(rows: DataFrame, keys: Sequence[str], ingest: str, time: str) -> DataFrame:
    """Flag rows whose time is before the time of the row ingested just before them."""
    prev = neighbour(range_chunks(rows, keys, [ingest]), keys, [ingest], {"_prev": time})
    flag = F.coalesce(F.col(time) < F.col("_prev"), F.lit(False))
    return prev.withColumn("out_of_order", flag).drop("_prev", "_chunk")


AS_OBSERVED, MARKET_TIME = "as_observed", "market_time_corrected"


def capture_order(capture: DataFrame, mode: str) -> DataFrame:
    """Replay position keys of captured rows, with copies collapsed.

    Adds ``replay_at`` and an ``issue``: ``missing_instant`` when the ordering clock is
    unknown, ``sequence_conflict`` when one ingest sequence carries different payloads.
    """
    clock = {AS_OBSERVED: "available_at", MARKET_TIME: "event_time"}[mode]
    payload = F.xxhash64(*[c for c in capture.columns if c != "ingest_sequence"])
    rest = [c for c in capture.columns if c != "ingest_sequence"]
    one = capture.withColumn("_h", payload).groupBy("ingest_sequence").agg(
        F.min_by(F.struct(*rest), "_h").alias("_row"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"),
        (F.count(F.lit(1)) - 1).alias("collapsed"),
    )
    out = one.select("ingest_sequence", *[F.col(f"_row.{c}").alias(c) for c in rest], "collapsed", "_lo", "_hi")
    issue = F.when(F.col("_lo") != F.col("_hi"), "sequence_conflict").when(F.col(clock).isNull(), "missing_instant")
    return out.withColumn("replay_at", F.col(clock)).withColumn("issue", issue).drop("_lo", "_hi")


def replay_stream(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """Bars and ticks in one frame with the sort keys of a mixed replay.

    Order: availability, bars before ticks, larger timeframe first, then ordinal.
    """
    b = bars.select(
        F.lit("bar").alias("kind"), "instrument", F.col("available_at").alias("known_at"), "tf_seconds",
        F.col("start").alias("at"), F.unix_micros("start").alias("ordinal"),
    )
    t = ticks.select(
        F.lit("tick").alias("kind"), "instrument", F.col("available_at").alias("known_at"), F.lit(0).alias("tf_seconds"),
        F.col("event_time").alias("at"), F.col("seq").alias("ordinal"),
    )
    return b.unionByName(t).withColumn("bar_last", (F.col("kind") == "tick").cast("int")).withColumn(
        "size_rank", -F.col("tf_seconds")
    )


REPLAY_KEYS = ["known_at", "bar_last", "size_rank", "ordinal", "instrument"]


def source_guard(rows: DataFrame, part: str, sequence: str, time: str, ident: str, expected_ident: Column) -> DataFrame:
    """Violations per source partition: identity, sequence and time order, partition order.

    Inside a partition rows are compared with their predecessor in sequence; across
    partitions only one (first, last) pair per partition is compared.
    """
    checked = neighbour(
        range_chunks(rows, [part], [sequence, ident]), [part], [sequence, ident], {"_ps": sequence, "_pt": time}
    )
    issues = F.array_compact(F.array(
        F.when(F.col(ident) != expected_ident, "identity_mismatch"),
        F.when(F.col(sequence) <= F.col("_ps"), "sequence_not_increasing"),
        F.when(F.col(time) < F.col("_pt"), "time_decreasing"),
    ))
    per_row = checked.withColumn("_issue", F.explode(issues)).groupBy(part, F.col("_issue").alias("issue")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    from pyspark.sql import Window

    edges = rows.groupBy(part).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    edges = edges.withColumn("_before", F.lag("_last").over(Window.orderBy(part)))
    across = edges.where(F.col("_first") < F.col("_before")).select(
        part, F.lit("partition_overlap").alias("issue"), F.lit(1).cast("bigint").alias("rows")
    )
    return per_row.unionByName(across)


def late_rows(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str], tf_start: Column, closed_end: Column) -> DataFrame:
    """Rows that arrive after a later interval of their key had already opened."""
    work = rows.withColumns({"_start": tf_start, "_opened": closed_end})
    seen = running(range_chunks(work, keys, arrival), keys, arrival, {"_newest": run_max("_start")}, inclusive=False)
    return seen.withColumn("late", F.coalesce(F.col("_start") < F.col("_newest"), F.lit(False))).drop(
        "_start", "_opened", "_newest", "_chunk"
    )
