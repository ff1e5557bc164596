"""Rule signals over bars: channel breakout, EMA cross, context direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import session_label
from tickloom.operators.bars import is_valid_bar, series


def signal_id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def donchian(bars: DataFrame, lookback: int = 20, allowed_sessions: Sequence[str] = ()) -> DataFrame:
    """Breakout of the channel of the previous ``lookback`` bars, with the reason if none.

    ``decision`` is signal, discarded, wait or blocked.
    """
    before = series().rowsBetween(-lookback, -1)
    rows = bars.withColumns({
        "_ok": is_valid_bar() & F.col("available_at").isNotNull(),
        "_n": F.count(F.lit(1)).over(before),
        "channel_upper": F.max("high").over(before),
        "channel_lower": F.min("low").over(before),
        "session": session_label("end"),
    })
    rows = rows.withColumns({
        "_all_ok": F.min(F.col("_ok").cast("int")).over(before) == 1,
        "_known": F.max("available_at").over(before),
    })
    reason = (
        F.when(~F.col("_ok"), "bar_not_available")
        .when(F.col("_n") < lookback, "warmup_pending")
        .when(~F.col("_all_ok"), "lookback_not_available")
        .when(F.col("_known") > F.col("available_at"), "lookback_future_data")
    )
    if allowed_sessions:
        reason = reason.when(~F.col("session").isin(*allowed_sessions), "session_filter_failed")
    direction = F.when(F.col("close") > F.col("channel_upper"), "UP").when(
        F.col("close") < F.col("channel_lower"), "DOWN"
    )
    reason = reason.when(direction.isNull(), "channel_breakout_absent")
    rows = rows.withColumn("reason", reason).withColumn(
        "direction", F.when(F.col("reason").isNull(), direction)
    )
    decision = (
        F.when(F.col("reason").isNull(), "signal")
        .when(F.col("reason") == "warmup_pending", "wait")
        .when(F.col("reason").isin("session_filter_failed", "channel_breakout_absent"), "discarded")
        .otherwise("blocked")
    )
    return rows.withColumn("decision", decision).drop("_ok", "_n", "_all_ok", "_known")


def ema_cross(points: DataFrame, rsi_threshold: float = 50.0) -> DataFrame:
    """Direction of a close crossing the fast EMA with the RSI on the same side."""
    w = series()
    rows = points.withColumns({
        "_pc": F.lag("close").over(w), "_pe": F.lag("ema_fast").over(w), "_pr": F.lag("ready").over(w)
    })
    both = F.col("ready") & F.coalesce(F.col("_pr"), F.lit(False))
    up = both & (F.col("_pc") <= F.col("_pe")) & (F.col("close") > F.col("ema_fast")) & (F.col("rsi") > rsi_threshold)
    down = both & (F.col("_pc") >= F.col("_pe")) & (F.col("close") < F.col("ema_fast")) & (F.col("rsi") < rsi_threshold)
    return rows.withColumn("direction", F.when(up, "UP").when(down, "DOWN")).drop("_pc", "_pe", "_pr")


def as_signals(rows: DataFrame, strategy: str) -> DataFrame:
    """Rows with a direction as a signal table with deterministic ids."""
    return rows.where(F.col("direction").isNotNull()).select(
        signal_id("sig_", F.lit(strategy), "instrument", F.unix_micros("start").cast("string"), "direction").alias("signal_id"),
        "instrument", "tf_seconds", "direction", F.col("available_at").alias("detected_at"), "start", "close",
        F.lit(strategy).alias("strategy"),
    )


def context_direction(points: DataFrame, lag: int = 3) -> DataFrame:
    """UP, DOWN or neutral by the two EMAs and the slope of the slow one; known or not."""
    w = series()
    rows = points.withColumns({
        "_ok": is_valid_bar(), "ema_slow_lag": F.lag("ema_slow", lag).over(w),
        "_lag_avail": F.lag("available_at", lag).over(w),
    })
    rows = rows.withColumn("_lag_ok", F.lag("_ok", lag).over(w))
    known = (
        F.col("_ok") & F.coalesce(F.col("_lag_ok"), F.lit(False)) & F.col("ema_slow_lag").isNotNull()
        & F.col("ema_fast").isNotNull() & F.col("ema_slow").isNotNull()
    )
    up = (F.col("ema_fast") > F.col("ema_slow")) & (F.col("ema_slow") > F.col("ema_slow_lag"))
    down = (F.col("ema_fast") < F.col("ema_slow")) & (F.col("ema_slow") < F.col("ema_slow_lag"))
    return rows.withColumns({
        "context_known": known,
        "context_direction": F.when(known & up, "UP").when(known & down, "DOWN"),
        "context_available": F.greatest("available_at", "_lag_avail"),
    }).drop("_ok", "_lag_ok", "_lag_avail")
