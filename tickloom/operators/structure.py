"""Descriptive structure of quote streams, spreads and capture coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import hour_block, seconds_between
from tickloom.operators.bars import histogram_quantiles, quantile_summary
from tickloom.operators.dedupe import first_wins
from tickloom.operators.scan import neighbour, range_chunks

ORDER = ["event_time", "seq"]


def quote_gaps(quotes: DataFrame, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """Each quote with the time and spread of the one before it."""
    work = quotes.withColumn("spread", F.col("ask") - F.col("bid"))
    near = neighbour(range_chunks(work, keys, ORDER), keys, ORDER, {"prev_time": "event_time", "prev_spread": "spread"})
    return near.withColumn("gap", seconds_between("prev_time", "event_time")).drop("_chunk")


def quote_structure(gaps: DataFrame, bound: float, keys: Sequence[str] = ("instrument",), unit: float = 1.0) -> DataFrame:
    """Counts, equal instants, gaps beyond the bound and the time-weighted spread."""
    inside = F.col("gap") <= bound
    covered = F.sum(F.when(inside, F.col("gap")))
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("quotes"), F.min("event_time").alias("first_quote"), F.max("event_time").alias("last_quote"),
        F.count_if(F.col("gap") == 0).alias("equal_times"), F.count_if(F.col("gap") > bound).alias("gaps_over_bound"),
        covered.alias("covered_seconds"),
        F.try_divide(F.sum(F.when(inside, F.col("gap") * F.col("prev_spread"))), covered * unit).alias("time_weighted_spread"),
    )


def labelled_groups(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Each row once per grouping: ``kind`` names it and ``label`` holds its value."""
    pairs = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.coalesce(c.cast("string"), F.lit("UNKNOWN")).alias("label")) for kind, c in groups.items()
    ])
    return rows.withColumn("_p", F.explode(pairs)).select("*", "_p.kind", "_p.label").drop("_p")


def spread_distribution(quotes: DataFrame, keys: Sequence[str] = ("instrument",), *, width: float = 0.01) -> DataFrame:
    """Spread moments and histogram quantiles: overall, by UTC hour, by eight-hour block."""
    work = quotes.withColumn("spread", F.col("ask") - F.col("bid"))
    groups = {"overall": F.lit("ALL"), "hour": F.hour("event_time"), "block": hour_block("event_time")}
    return histogram_quantiles(labelled_groups(work, groups), [*keys, "kind", "label"], "spread", width=width)


def daily_coverage(quotes: DataFrame, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    return quotes.groupBy(*keys, F.to_date("event_time").alias("day")).agg(
        F.count(F.lit(1)).alias("ticks"), F.min("event_time").alias("first_quote"), F.max("event_time").alias("last_quote")
    )


def largest(rows: DataFrame, keys: Sequence[str], value: str, tie: str, k: int) -> DataFrame:
    """Top ``k`` per key; the rank filter is applied per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def spread_report(quotes: DataFrame, *, ident: str = "event_id", session: Column, timeframe: Column, atr: str = "atr") -> DataFrame:
    """Spread and spread/ATR summaries: overall, by timeframe, hour and session.

    A quote seen twice counts once; a crossed quote or a missing side is unknown.
    """
    one = first_wins(quotes, [ident], ["event_time", "seq"])
    usable = F.col("bid").isNotNull() & F.col("ask").isNotNull() & (F.col("ask") >= F.col("bid"))
    work = one.withColumn("spread", F.when(usable, F.col("ask") - F.col("bid")))
    work = work.withColumn("spread_atr", F.when(F.col(atr) > 0, F.col("spread") / F.col(atr)))
    groups = {"overall": F.lit("ALL"), "timeframe": timeframe, "hour": F.hour("event_time"), "session": session}
    wide = labelled_groups(work, groups)
    keys = ["kind", "label"]
    plain = quantile_summary(wide, keys, "spread")
    ratio = quantile_summary(wide, keys, "spread_atr")
    return plain.join(ratio.select(*keys, *[F.col(c).alias(f"atr_{c}") for c in ("known", "unknown", "mean", "p50", "p95")]), keys)


def coverage(rows: DataFrame, keys: Sequence[str], *, clock: str, requested: tuple[str, str], max_gap: float, available: str) -> DataFrame:
    """Observed span against a requested one, continuity and known availability."""
    order = [clock, "seq"]
    near = neighbour(range_chunks(rows, keys, order), keys, order, {"_prev": clock})
    gap = seconds_between("_prev", clock)
    out = near.groupBy(*keys).agg(
        F.min(clock).alias("observed_start"), F.max(clock).alias("observed_end"), F.max(gap).alias("_gap"),
        F.bool_and(F.col(available).isNotNull()).alias("availability_known"),
    )
    lo, hi = (F.lit(r).cast("timestamp") for r in requested)
    continuity = F.when(F.col("_gap").isNull(), "UNKNOWN").when(F.col("_gap") <= max_gap, "CONTINUOUS").otherwise("DISCONTINUOUS")
    covers = (F.col("observed_start") <= lo) & (F.col("observed_end") >= hi)
    out = out.withColumns({"continuity": continuity, "range_covered": covers})
    return out.withColumn("complete", covers & (F.col("continuity") == "CONTINUOUS")).drop("_gap")


def quality_summary(rows: DataFrame, keys: Sequence[str], *, time: str, ingest: str, ident: str, invalid: Column) -> DataFrame:
    """Record, duplicate, disorder and invalid counts with the covered span."""
    near = neighbour(range_chunks(rows, keys, [ingest]), keys, [ingest], {"_prev": time})
    base = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col(time) < F.col("_prev")).alias("out_of_order"),
        F.count_if(invalid).alias("invalid"), F.min(time).alias("coverage_start"), F.max(time).alias("coverage_end"),
        F.count_distinct(ident).alias("_ids"),
    )
    return base.withColumn("duplicates", F.col("records") - F.col("_ids")).drop("_ids")
