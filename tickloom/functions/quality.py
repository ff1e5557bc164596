"""Quality flags, validation of ticks, bars and two-leg quotes as issue arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import C, codes, col, effective_available, finite, selected_price

# Flag names, in the order that decides the scalar status.
STATUS_ORDER = (
    "invalid", "disconnected", "stale", "unreconciled", "gap", "out_of_order", "duplicate",
    "insufficient", "partial", "open", "late", "synthetic",
)
# Flags that make a row unusable.
BLOCKING = (
    "invalid", "duplicate", "out_of_order", "gap", "disconnected", "stale", "unreconciled",
    "insufficient", "partial", "open", "late",
)


def _literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def no_flags() -> Column:
    return F.array().cast("array<string>")


def is_blocked(flags: C) -> Column:
    return F.coalesce(F.arrays_overlap(col(flags), _literal_array(BLOCKING)), F.lit(False))


def status(flags: C) -> Column:
    """One label per row by fixed precedence."""
    present = F.filter(_literal_array(STATUS_ORDER), lambda name: F.array_contains(col(flags), name))
    return F.coalesce(F.try_element_at(present, F.lit(1)), F.lit("valid"))


def merged_flags(flags: C) -> Column:
    """Aggregate: union of the flag sets of a group (a set over a fixed vocabulary)."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(col(flags)))))


def with_flag(flags: C, condition: Column, flag: str) -> Column:
    return F.when(condition, F.array_sort(F.array_union(col(flags), F.array(F.lit(flag))))).otherwise(col(flags))


def tick_issues() -> Column:
    """Issue codes of a tick row; an empty array means accepted."""
    bad_number = F.lit(False)
    for name in ("price", "quantity", "bid", "ask"):
        bad_number = bad_number | (F.col(name).isNotNull() & ~finite(name))
    available = effective_available()
    return codes([
        ("instrument_missing", F.coalesce(F.trim("instrument"), F.lit("")) == ""),
        ("timestamp_invalid", F.col("event_time").isNull()),
        ("received_before_event", F.col("received_at") < F.col("event_time")),
        ("available_before_event", available < F.col("event_time")),
        ("non_finite", bad_number),
        ("price_base_missing", ~finite(selected_price())),
        ("quantity_negative", F.col("quantity") < 0),
        ("quality_blocked", is_blocked("quality_flags")),
    ])


def validate_ticks(ticks: DataFrame) -> DataFrame:
    """Rows with ``issues`` and ``accepted``; nothing is dropped here."""
    return ticks.withColumn("issues", tick_issues()).withColumn("accepted", F.size("issues") == 0)


def bar_issues(*, require_closed: bool = False) -> Column:
    measures = ("open", "high", "low", "close", "volume")
    all_finite = F.lit(True)
    for name in measures:
        all_finite = all_finite & finite(name)
    start, end = F.unix_micros("start"), F.unix_micros("end")
    interval_ok = (end > start) & (end - start == F.col("tf_seconds").cast("bigint") * F.lit(1_000_000))
    checkable = all_finite & interval_ok
    return codes([
        ("interval_invalid", end <= start),
        ("timeframe_mismatch", end - start != F.col("tf_seconds").cast("bigint") * F.lit(1_000_000)),
        ("non_finite", ~all_finite),
        (
            "ohlc_incoherent",
            checkable
            & (
                (F.col("high") < F.greatest("open", "close", "low"))
                | (F.col("low") > F.least("open", "close", "high"))
            ),
        ),
        ("negative_measure", checkable & ((F.col("volume") < 0) | (F.col("event_count") < 0))),
        ("candle_open", F.lit(require_closed) & ~F.col("closed")),
        ("quality_blocked", is_blocked("quality_flags")),
    ])


def validate_bars(bars: DataFrame, *, require_closed: bool = False) -> DataFrame:
    issues = bar_issues(require_closed=require_closed)
    return bars.withColumn("issues", issues).withColumn("accepted", F.size("issues") == 0)


def freshness(
    feed: DataFrame,
    now: C,
    *,
    keys: list[str],
    received: str,
    bar_end: str,
    closed: str,
    max_feed_age: float,
    max_bar_age: float,
) -> DataFrame:
    """Age of the feed and of the last closed bar per key, with STALE / LATE flags.

    A missing side is flagged; an instant after ``now`` gives the status ``future``.
    """
    latest = feed.groupBy(*keys).agg(
        F.max(received).alias("last_received"), F.max(F.when(F.col(closed), F.col(bar_end))).alias("last_closed")
    )
    age = lambda c: (F.unix_micros(col(now)) - F.unix_micros(c)) / F.lit(1_000_000)
    out = latest.withColumns({"feed_age": age("last_received"), "bar_age": age("last_closed")})
    flags = codes([
        ("stale", F.col("feed_age").isNull() | (F.col("feed_age") > max_feed_age)),
        ("late", F.col("bar_age").isNull() | (F.col("bar_age") > max_bar_age)),
    ])
    future = (F.coalesce(F.col("feed_age"), F.lit(0)) < 0) | (F.coalesce(F.col("bar_age"), F.lit(0)) < 0)
    return out.withColumn("flags", flags).withColumn(
        "state", F.when(future, "future").otherwise(status("flags"))
    )


def leg_reasons(
    side: str,
    *,
    price: C,
    source_time: C,
    received_at: C,
    available_at: C,
    session: C,
    quality: C,
    checked_at: C,
    max_age_seconds: float,
    expected_session: C,
    connected: C,
    snapshot: C,
    out_of_order: C,
) -> Column:
    """Reasons why one side of a quote cannot be used; an empty array means usable.

    The time checks are exclusive: the first that applies is the only one reported.
    """
    t, now = col(source_time), col(checked_at)
    age = (F.unix_micros(now) - F.unix_micros(t)) / F.lit(1_000_000)
    timing = (
        F.when(t.isNull(), "MISSING_SOURCE_TIMESTAMP")
        .when(t > now, "FUTURE_SOURCE_TIMESTAMP")
        .when((col(received_at) > now) | (col(available_at) > now), "FUTURE_AVAILABILITY")
        .when(age > max_age_seconds, "STALE")
    )
    usable_quality = F.lower(col(quality)).isin("valid", "synthetic")
    mismatch = col(session).isNotNull() & (col(session) != col(expected_session))
    spoiled = ~col(connected) | col(snapshot) | col(out_of_order) | mismatch | ~usable_quality
    state = codes([
        (f"MISSING_{side}", col(price).isNull()),
        ("DISCONNECTED", ~col(connected)),
        ("SNAPSHOT", col(snapshot)),
        ("OUT_OF_ORDER", col(out_of_order)),
        ("SESSION_MISMATCH", mismatch),
        ("INVALID_QUALITY", spoiled),
    ])
    return F.array_compact(F.concat(state, F.array(timing)))


def pair_reasons(bid_reasons: C, ask_reasons: C, *, bid: C, ask: C) -> Column:
    crossed = F.array_compact(F.array(F.when(col(ask) < col(bid), "CROSSED")))
    return F.array_distinct(F.concat(col(bid_reasons), col(ask_reasons), crossed))
