"""First-touch exits and mark-to-market of trades against a quote history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.calendar import next_weekly_close
from tickloom.functions.columns import plus_seconds
from tickloom.operators import intervals
from tickloom.operators.asof import latest_known
from tickloom.operators.bars import series
from tickloom.operators.scan import range_chunks, run_sum, running
from tickloom.operators.structure import quote_gaps


def time_limits(
    trades: DataFrame, bars: DataFrame, ident: str, *, max_bars: int | None = None, max_hours: float | None = None,
    preclose_minutes: float | None = None,
) -> DataFrame:
    """The instant and reason at which time ends each trade, as ``close_at`` and ``time_reason``.

    The earliest of: the end of the ``max_bars``-th bar that starts at or after the entry,
    a holding time, and a margin before the next weekly close. ``bars`` is one timeframe.
    """
    ends = F.lead("end", max_bars or 1).over(series())
    indexed = bars.select("instrument", "tf_seconds", "start", "end").withColumn("_limit", ends)
    rows = latest_known(
        trades, indexed, left_at="entry_at", left_id=[ident], time="start", available="start", right_id=["tf_seconds"],
        values=["_limit"], prefix="_b",
    )
    us = F.unix_micros
    none = F.lit(None).cast("timestamp")
    by_bars = F.col("_b_limit") if max_bars else none
    by_hours = plus_seconds("entry_at", max_hours * 3600) if max_hours else none
    cut = F.greatest(F.col("entry_at"), plus_seconds(next_weekly_close("entry_at"), -60 * (preclose_minutes or 0)))
    by_close = cut if preclose_minutes is not None else none
    limit = F.least(by_bars, by_hours, by_close)
    reason = (
        F.when(us(by_bars) == us(limit), "MAX_BARS").when(us(by_hours) == us(limit), "MAX_HOURS").otherwise("PRE_WEEKLY_CLOSE")
    )
    return rows.withColumns({"close_at": limit, "time_reason": F.when(limit.isNotNull(), reason)}).select(
        *trades.columns, *[c for c in ("close_at", "time_reason") if c not in trades.columns]
    )


def first_touch(trades: DataFrame, quotes: DataFrame, ident: str, *, gap_bound: float | None = None) -> DataFrame:
    """Which of stop, target or time ends each trade, and when.

    ``trades``: instrument, direction, entry_at, close_at (the time limit), stop, target.
    A long liquidates at the bid, a short at the ask. On one quote the stop wins. With
    ``gap_bound`` (seconds) ``gap`` tells whether the touching quote followed a longer pause.
    """
    up = F.col("direction") == "UP"
    legs = F.array(
        F.struct(
            F.lit("STOP").alias("leg"), F.when(up, "bid_down").otherwise("ask_up").alias("series"),
            F.when(up, -F.col("stop")).otherwise(F.col("stop")).alias("threshold"),
        ),
        F.struct(
            F.lit("TARGET").alias("leg"), F.when(up, "bid_up").otherwise("ask_down").alias("series"),
            F.when(up, F.col("target")).otherwise(-F.col("target")).alias("threshold"),
        ),
    )
    barriers = trades.withColumn("_l", F.explode(legs)).select(
        "instrument", ident, "_l.*", F.unix_micros("entry_at").alias("_s"), F.unix_micros("close_at").alias("_e")
    )
    hits = intervals.first_reach(barriers, quotes, [ident, "leg"], start_us="_s", end_us="_e")
    per_trade = hits.groupBy(ident).agg(
        F.min(F.when(F.col("leg") == "STOP", F.col("touch_us"))).alias("_stop"),
        F.min(F.when(F.col("leg") == "TARGET", F.col("touch_us"))).alias("_target"),
    )
    rows = trades.join(per_trade, ident, "left")
    stop_first = F.col("_stop").isNotNull() & (F.col("_target").isNull() | (F.col("_stop") <= F.col("_target")))
    exit_ = F.when(stop_first, "STOP").when(F.col("_target").isNotNull(), "TARGET").otherwise("TIME")
    at = F.coalesce(F.timestamp_micros(F.least("_stop", "_target")), F.col("close_at"))
    out = rows.withColumns({"exit": exit_, "exit_at": at}).drop("_stop", "_target")
    if gap_bound is None:
        return out
    pauses = quote_gaps(quotes).where(F.col("gap") > gap_bound).select("instrument", F.col("event_time").alias("exit_at"))
    late = pauses.distinct().withColumn("_late", F.lit(True))
    flagged = out.join(late, ["instrument", "exit_at"], "left")
    return flagged.withColumn("gap", F.coalesce("_late", F.lit(False)) & (F.col("exit") != "TIME")).drop("_late")


def mark_to_market(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per quote: realised net, unrealised result, exposure; equity NULL when not markable.

    Open value is linear in the quote, so running sums of units and of units times entry
    price, kept apart for longs and shorts, replace the pairing of quotes and trades.
    """
    up = F.col("direction") == "UP"
    zero = F.lit(0.0)
    one = F.lit(0).cast("bigint")
    entry = F.struct(
        F.col("entry_at").alias("at"), F.lit("0").alias("side"), F.when(up, F.col("units")).otherwise(zero).alias("lu"),
        F.when(up, F.col("units") * F.col("entry_price")).otherwise(zero).alias("lv"),
        F.when(up, zero).otherwise(F.col("units")).alias("su"),
        F.when(up, zero).otherwise(F.col("units") * F.col("entry_price")).alias("sv"), zero.alias("net"), one.alias("bad"),
    )
    leave = F.struct(
        F.col("close_at").alias("at"), F.lit("1").alias("side"), F.when(up, -F.col("units")).otherwise(zero).alias("lu"),
        F.when(up, -F.col("units") * F.col("entry_price")).otherwise(zero).alias("lv"),
        F.when(up, zero).otherwise(-F.col("units")).alias("su"),
        F.when(up, zero).otherwise(-F.col("units") * F.col("entry_price")).alias("sv"),
        F.coalesce(F.col("net"), zero).alias("net"), F.col("net").isNull().cast("bigint").alias("bad"),
    )
    events = trades.withColumn("_e", F.explode(F.array(entry, leave))).select(
        "instrument", "_e.at", F.lit(0).alias("kind"), F.concat("trade_id", "_e.side").alias("tie"),
        "_e.lu", "_e.lv", "_e.su", "_e.sv", "_e.net", "_e.bad",
    )
    marks = quotes.select(
        "instrument", F.col("event_time").alias("at"), F.lit(1).alias("kind"), F.col("seq").cast("string").alias("tie"), "seq", "bid", "ask"
    )
    both = events.unionByName(marks, allowMissingColumns=True)
    keys, order = ["instrument"], ["at", "kind", "tie"]
    sums = running(range_chunks(both, keys, order), keys, order, {f"_{c}": run_sum(c) for c in ("lu", "lv", "su", "sv", "net", "bad")})
    rows = sums.where(F.col("kind") == 1)
    c = lambda n: F.coalesce(F.col(f"_{n}"), zero)
    unrealised = F.col("bid") * c("lu") - c("lv") + c("sv") - F.col("ask") * c("su")
    exposure = F.col("bid") * c("lu") + F.col("ask") * c("su")
    unknown = F.coalesce(F.col("_bad"), one)
    markable = (F.col("bid").isNotNull() | (c("lu") == 0)) & (F.col("ask").isNotNull() | (c("su") == 0))
    return rows.select(
        "instrument", "seq", "at", c("net").alias("realised"), unknown.alias("unknown_closed"), unrealised.alias("unrealised"),
        exposure.alias("exposure"), F.when((unknown == 0) & markable, c("net") + unrealised).alias("equity"),
    )
