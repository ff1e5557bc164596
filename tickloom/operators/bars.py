"""Bars from ticks and quotes, resampling, structure of a bar series.

A bar exists only where ticks exist. Grouping to (instrument, interval) combines on the
map side, so a hot instrument shuffles partial aggregates, not ticks. Windows over bars
run per (instrument, timeframe): their length is bounded by the time span divided by the
timeframe, whatever the number of ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.functions.columns import (
    effective_available,
    interval_start,
    plus_seconds,
    seconds_between,
    selected_price,
)
from tickloom.functions.quality import is_blocked, merged_flags, validate_ticks, with_flag
from tickloom.operators.scan import exact_quantiles, neighbour, range_chunks, union_all
from tickloom.session import pin

BAR_KEYS = ["instrument", "tf_seconds"]


def order_key() -> Column:
    """Canonical order of ticks inside an instrument."""
    return F.struct(
        F.col("event_time"),
        effective_available().alias("available"),
        F.coalesce(F.col("received_at"), F.col("event_time")).alias("received"),
        F.col("seq").isNull().alias("seq_missing"),
        F.col("seq"),
        F.col("event_id"),
    )


def series() -> Window:
    return Window.partitionBy(*BAR_KEYS).orderBy("start")


def _ohlc(rows: DataFrame, tf: int, *extra: Column) -> DataFrame:
    priced = rows.withColumns({
        "_price": selected_price(),
        "_avail": effective_available(),
        "start": interval_start("event_time", tf),
        "_key": order_key(),
    })
    return priced.groupBy("instrument", "start").agg(
        F.min_by("_price", "_key").alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", "_key").alias("close"),
        F.sum(F.coalesce("quantity", F.lit(0.0))).alias("volume"),
        F.count(F.lit(1)).alias("event_count"),
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
        F.min_by("_avail", "_key").alias("_first_avail"),
        F.max("_avail").alias("_latest_avail"),
        merged_flags("quality_flags").alias("_flags"),
        *extra,
    )


def _finish(bars: DataFrame, tf: int, partial: Column) -> DataFrame:
    """Close every bar that a later bar revealed; the last one closes only when complete."""
    w = Window.partitionBy("instrument").orderBy("start")
    out = bars.withColumns({
        "tf_seconds": F.lit(tf),
        "end": plus_seconds("start", tf),
        "partial": partial,
        "_opened_next": F.lead("_first_avail").over(w),
    })
    closed = F.col("_opened_next").isNotNull() | ~F.col("partial")
    known = F.coalesce(F.col("_opened_next"), F.when(closed, F.col("end")))
    return out.withColumns({
        "closed": closed,
        "available_at": F.when(closed, F.greatest("end", known, "_latest_avail")).otherwise(F.col("_latest_avail")),
        "quality_flags": with_flag("_flags", F.col("partial"), "partial"),
        "revision": F.lit(1),
    })


_BAR_COLUMNS = [
    "instrument", "tf_seconds", "start", "end", "open", "high", "low", "close", "volume", "event_count",
    "closed", "partial", "available_at", "quality_flags", "revision",
]


def tick_bars(ticks: DataFrame, tf: int, *, validate: bool = True) -> DataFrame:
    """Strict bars: a bar whose first tick is after its start is partial."""
    rows = validate_ticks(ticks).where("accepted") if validate else ticks
    bars = _ohlc(rows, tf)
    return _finish(bars, tf, F.col("first_event") > F.col("start")).select(*_BAR_COLUMNS)


def quote_bars(
    quotes: DataFrame, tf: int | Sequence[int], max_gap: float, *, use_calendar: bool = False
) -> DataFrame:
    """Bars from a quote stream that is continuous up to ``max_gap`` open seconds.

    ``quotes`` has the tick layout. A bar is not partial when its first quote follows the
    last quote of the adjacent bar within the bound. Several timeframes share one ordered
    pass over the quotes.
    """
    sizes = [tf] if isinstance(tf, int) else list(tf)
    order = ["event_time", "seq", "event_id"]
    chunked = range_chunks(quotes, ["instrument"], order)
    rows = neighbour(chunked, ["instrument"], order, {"_prev_time": "event_time"})
    span = cal.open_seconds if use_calendar else seconds_between
    rows = rows.withColumn("_gap", span("_prev_time", "event_time"))
    if len(sizes) > 1:
        rows = pin(rows)
    return union_all([_continuous(rows, size, max_gap, span, use_calendar) for size in sizes])


def _continuous(rows: DataFrame, tf: int, max_gap: float, span, use_calendar: bool) -> DataFrame:
    inside = F.col("_prev_time") >= interval_start("event_time", tf)
    bars = _ohlc(
        rows, tf,
        F.coalesce(F.max(F.when(inside, F.col("_gap"))), F.lit(0.0)).alias("_inner_gap"),
        F.min_by("_gap", "_key").alias("_entry_gap"),
    )
    w = Window.partitionBy("instrument").orderBy("start")
    bars = bars.withColumns({"_prev_end": plus_seconds(F.lag("start").over(w), tf), "_end": plus_seconds("start", tf)})
    adjacent = F.col("_prev_end") == F.col("start")
    if use_calendar:
        adjacent = adjacent | cal.covers_closed("_prev_end", "start")
    continuous = F.coalesce(adjacent & F.col("_entry_gap").between(0, max_gap), F.lit(False))
    gap = (F.col("_inner_gap") > max_gap) | (span("last_event", "_end") > max_gap)
    bars = bars.withColumn("_flags", with_flag("_flags", gap, "gap"))
    partial = (F.col("first_event") > F.col("start")) & ~continuous
    return _finish(bars, tf, partial).select(*_BAR_COLUMNS)


def is_valid_bar() -> Column:
    return F.col("closed") & ~is_blocked("quality_flags")


def resample(bars: DataFrame, tf: int) -> DataFrame:
    """Larger bars from closed smaller ones; incomplete intervals come back as gaps.

    The result has one row per target interval with ``complete`` telling the two apart.
    """
    target = bars.withColumn("_at", interval_start("start", tf))
    grouped = target.groupBy("instrument", F.col("tf_seconds").alias("source_tf"), "_at").agg(
        F.min_by("open", "start").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "start").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("event_count").alias("event_count"),
        F.count(F.lit(1)).alias("parts"),
        F.count_distinct("start").alias("_starts"),
        F.bool_and("closed").alias("_closed"),
        F.max("available_at").alias("_avail"),
        merged_flags("quality_flags").alias("quality_flags"),
    )
    ratio = F.lit(tf) / F.col("source_tf")
    whole = F.pmod(F.lit(tf), F.col("source_tf")) == 0
    complete = whole & (F.col("parts") == ratio) & (F.col("_starts") == ratio) & F.col("_closed")
    out = grouped.withColumns({
        "tf_seconds": F.lit(tf), "start": F.col("_at"), "end": plus_seconds("_at", tf), "complete": complete,
        "closed": complete, "partial": ~complete, "revision": F.lit(1),
    })
    out = out.withColumn("available_at", F.greatest("end", "_avail"))
    return out.select(*_BAR_COLUMNS, "source_tf", "parts", "complete")


def prefer_native(native: DataFrame, derived: DataFrame) -> DataFrame:
    """Native bars, plus derived ones for the intervals that have no native bar."""
    keys = [*BAR_KEYS, "start"]
    ranked = native.withColumn("origin", F.lit("native")).unionByName(
        derived.join(native.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("derived")),
        allowMissingColumns=True,
    )
    return ranked


def missing_intervals(bars: DataFrame, *, span_seconds: int | None = None) -> DataFrame:
    """Expected starts between the first and last bar of a series that are absent.

    Works from the gaps, so only the absent starts are generated, and a hot instrument
    contributes at most one row per interval of its span.
    """
    gaps = bar_gaps(bars)
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("tf_seconds"))
    last = plus_seconds("gap_end", -F.col("tf_seconds"))
    return gaps.select(*BAR_KEYS, F.explode(F.sequence("gap_start", last, step)).alias("start"))


def bar_gaps(bars: DataFrame) -> DataFrame:
    w = series()
    prev = bars.withColumns({"gap_start": F.lag("end").over(w), "previous_start": F.lag("start").over(w)})
    return prev.where(F.col("start") > F.col("gap_start")).select(
        *BAR_KEYS, "gap_start", F.col("start").alias("gap_end"),
        seconds_between("gap_start", "start").alias("seconds"), "previous_start", F.col("start").alias("next_start"),
    )


def latest_revision(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Highest revision per interval, by aggregation (no sort of the copies)."""
    keys = keys or [*BAR_KEYS, "start"]
    rest = [c for c in bars.columns if c not in keys]
    order = F.struct("revision", *[c for c in rest if c not in ("revision", "quality_flags")])
    picked = bars.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*bars.columns)


def last_contiguous_run(bars: DataFrame, cutoff: Column, required: int) -> DataFrame:
    """Length of the last unbroken run of closed bars up to a cutoff, against a need."""
    w = series()
    usable = bars.where(F.col("closed") & (F.col("end") <= cutoff))
    islands = usable.withColumn(
        "_island", F.sum((F.col("start") != F.coalesce(F.lag("end").over(w), F.col("start"))).cast("int")).over(w)
    )
    runs = islands.groupBy(*BAR_KEYS, "_island").agg(
        F.count(F.lit(1)).alias("run_length"), F.min("start").alias("run_start"), F.max("end").alias("run_end")
    )
    last = runs.groupBy(*BAR_KEYS).agg(F.max_by(F.struct("run_length", "run_start", "run_end"), "_island").alias("r"))
    return last.select(*BAR_KEYS, "r.*", (F.col("r.run_length") >= required).alias("ready"))


def history_continuity(bars: DataFrame, wanted: int) -> DataFrame:
    """The newest ``wanted`` bars of each series: complete or partial, continuous or not."""
    recent = bars.withColumn("_rn", F.row_number().over(Window.partitionBy(*BAR_KEYS).orderBy(F.desc("start"))))
    recent = recent.where(F.col("_rn") <= wanted)
    linked = recent.withColumn("_ok", F.col("start") == F.coalesce(F.lag("end").over(series()), F.col("start")))
    return linked.groupBy(*BAR_KEYS).agg(
        F.count(F.lit(1)).alias("bars"),
        F.min("start").alias("first_start"),
        F.max("end").alias("last_end"),
        F.when(F.count(F.lit(1)) >= wanted, "COMPLETE").otherwise("PARTIAL").alias("selection"),
        F.when(F.bool_and("_ok"), "CONTINUOUS").otherwise("DISCONTINUOUS").alias("continuity"),
    )


def return_structure(bars: DataFrame) -> DataFrame:
    """Counts, realised volatility and lag-1 correlation of contiguous log returns."""
    w = series()
    rows = bars.withColumns({"_valid": is_valid_bar(), "_prev_end": F.lag("end").over(w)})
    rows = rows.withColumns({"_prev_close": F.lag("close").over(w), "_prev_valid": F.lag("_valid").over(w)})
    linked = F.col("_valid") & F.col("_prev_valid") & (F.col("_prev_end") == F.col("start"))
    rows = rows.withColumn("_r", F.when(linked, F.log(F.col("close") / F.col("_prev_close"))))
    rows = rows.withColumn("_r0", F.when(linked, F.lag("_r").over(w)))
    both = F.col("_r").isNotNull() & F.col("_r0").isNotNull()
    return rows.groupBy(*BAR_KEYS).agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if("_valid").alias("valid_bars"),
        F.count("_r").alias("returns"),
        F.sqrt(F.sum(F.col("_r") * F.col("_r"))).alias("realized"),
        F.count_if(both).alias("pairs"),
        F.corr(F.when(both, F.col("_r0")), F.when(both, F.col("_r"))).alias("lag1_corr"),
    )


def histogram_quantiles(
    df: DataFrame, keys: list[str], value: str, *, width: float = 0.01, bins: int = 10_000,
    probs: tuple[float, ...] = (0.5, 0.9, 0.99),
) -> DataFrame:
    """Moments plus quantiles as histogram intervals [lower, lower + width).

    Work per key is bounded by the number of bins; values past the last bin fall in an
    overflow bin whose upper edge is unknown.
    """
    wanted = list(keys)
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    binned = df.where(F.col(value).isNotNull()).withColumn(
        "_bin", F.least(F.floor(F.col(value) / width), F.lit(bins)).cast("bigint")
    )
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_cnt"))
    upto = Window.partitionBy(*keys).orderBy("_bin")
    everything = Window.partitionBy(*keys)
    ranked = counts.withColumns({"_cum": F.sum("_cnt").over(upto), "_n": F.sum("_cnt").over(everything)})
    picks = []
    for p in probs:
        tag = f"p{round(p * 100)}"
        hit = F.min(F.when(F.col("_cum") >= F.ceil(F.lit(p) * F.col("_n")), F.col("_bin")))
        picks.append((F.when(hit < bins, hit * width).otherwise(F.lit(bins * width))).alias(f"{tag}_lower"))
        picks.append((F.when(hit < bins, (hit + 1) * width)).alias(f"{tag}_upper"))
    quant = ranked.groupBy(*keys).agg(*picks)
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    out = moments.join(quant, keys, "left")
    return out if wanted else out.drop("_all")


def quantile_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, unknown, min, max, mean, p50 and p95 of a measure that may be unknown."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("known"), F.count_if(F.col(value).isNull()).alias("unknown"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
    )
    if not keys:
        raise ValueError("quantile_summary needs at least one key column")
    return base.join(exact_quantiles(df, keys, value, {"p50": 0.5, "p95": 0.95}), keys, "left")
