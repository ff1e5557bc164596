"""Queries over ticks, bars and their structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.plans import inputs as I
from tickloom.plans.inputs import SQL, sql_bars, sql_strict_bars, with_ctes
from tickloom.plans.registry import query, rnd, text_list


@query(
    "a1_ohlc_bars",
    with_ctes(
        SQL["ticks"], sql_strict_bars(3600),
        select="""SELECT instrument, start, "end", open, high, low, close, volume, event_count, partial, closed,
                  available_at FROM bars""",
    ),
)
def a1_ohlc_bars(spark, sf):
    return I.strict_bars(spark, sf).select(
        "instrument", "start", "end", "open", "high", "low", "close", "volume", "event_count", "partial", "closed",
        "available_at",
    )


@query(
    "a2_quote_bars_continuity",
    with_ctes(
        SQL["quotes"], sql_bars(),
        select="""SELECT instrument, start, "end", open, high, low, close, event_count, partial, closed, available_at,
                  CASE WHEN gap AND partial THEN 'gap,partial,valid' WHEN gap THEN 'gap,valid'
                       WHEN partial THEN 'partial,valid' ELSE 'valid' END AS quality_flags FROM bars""",
    ),
)
def a2_quote_bars_continuity(spark, sf):
    return I.bars(spark, sf).select(
        "instrument", "start", "end", "open", "high", "low", "close", "event_count", "partial", "closed",
        "available_at", text_list("quality_flags"),
    )
