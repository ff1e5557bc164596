"""Compact delta encodings turned into rows by explode and running sums.

A block or a page is one input row or a few, so its length is bounded by what the
sender put in one message; no group grows with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import codes, plus_seconds

BLOCK_SCHEMA = (
    "timestamp bigint, bid decimal(20,10), ask decimal(20,10), multiplier decimal(20,10), "
    "times array<bigint>, bids array<decimal(20,10)>, asks array<decimal(20,10)>"
)


def decode_tick_blocks(blocks: DataFrame, keys: Sequence[str], *, body: str = "body", hour: str = "hour") -> DataFrame:
    """Ticks of JSON delta blocks; a block with any fault yields one row with its issue.

    Deltas are whole multiples of the multiplier; times are non-negative milliseconds.
    """
    b = blocks.withColumn("_b", F.from_json(body, BLOCK_SCHEMA))
    whole = lambda name: F.forall(f"_b.{name}", lambda d: d.isNotNull() & (d == F.round(d, 0)))
    issue = codes([
        ("unreadable", F.col("_b.times").isNull() | F.col("_b.timestamp").isNull() | (F.col("_b.multiplier") <= 0)),
        ("length_mismatch", (F.size("_b.bids") != F.size("_b.times")) | (F.size("_b.asks") != F.size("_b.times"))),
        ("negative_delta", F.exists("_b.times", lambda d: d < 0)),
        ("fractional_delta", ~whole("bids") | ~whole("asks")),
    ])
    b = b.withColumn("issue", F.try_element_at(issue, F.lit(1)))
    ok = b.where(F.col("issue").isNull())
    flat = ok.select(
        *keys, hour, F.col("_b.timestamp").alias("_t0"), F.col("_b.bid").alias("_b0"), F.col("_b.ask").alias("_a0"),
        F.col("_b.multiplier").alias("_m"),
        F.posexplode(F.arrays_zip("_b.times", "_b.bids", "_b.asks")).alias("ordinal", "d"),
    )
    w = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    price = lambda base, d: (F.col(base) + (F.sum(d).over(w) * F.col("_m")).cast("decimal(30,10)")).cast("decimal(20,10)")
    ticks = flat.withColumns({
        "_ms": F.col("_t0") + F.sum("d.times").over(w), "bid": price("_b0", "d.bids"), "ask": price("_a0", "d.asks"),
    }).withColumn("event_time", F.timestamp_millis("_ms"))
    bad = (
        (F.col("bid") <= 0) | (F.col("ask") < F.col("bid")) | (F.col("event_time") < F.col(hour))
        | (F.col("event_time") >= plus_seconds(hour, 3600))
    )
    ticks = ticks.withColumn("_bad", F.max(bad.cast("int")).over(Window.partitionBy(*keys)))
    good = ticks.where(F.col("_bad") == 0).select(*keys, "ordinal", "event_time", "bid", "ask", F.lit(None).cast("string").alias("issue"))
    broken = ticks.where(F.col("_bad") == 1).select(*keys).distinct().withColumn("issue", F.lit("invalid_tick"))
    refused = b.where(F.col("issue").isNotNull()).select(*keys, "issue").unionByName(broken)
    return good.unionByName(refused, allowMissingColumns=True)


def decode_tick_pages(
    pages: DataFrame, keys: Sequence[str], *, from_ms: str, to_ms: str, scale: int = 100_000
) -> DataFrame:
    """Newest-first delta pages: first row absolute, the rest deltas of time and price.

    A row out of order or outside the window cuts its page: it and all later rows are
    marked ``cut``. Bid and ask pages stay separate.
    """
    w = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumns({"absolute_ms": F.sum("timestamp").over(w), "absolute_tick": F.sum("tick").over(w)})
    missing = F.max((F.col("timestamp").isNull() | F.col("tick").isNull()).cast("int")).over(w) == 1
    newer = (F.col("ordinal") > 0) & (F.col("timestamp") > 0)
    outside = (F.col("absolute_ms") < F.col(from_ms)) | (F.col("absolute_ms") > F.col(to_ms))
    rows = rows.withColumn("_bad", (missing | newer | outside).cast("int"))
    rows = rows.withColumn("cut", F.max("_bad").over(w) == 1)
    return rows.withColumns({
        "event_time": F.timestamp_millis("absolute_ms"), "price": F.col("absolute_tick") / F.lit(scale),
    }).drop("_bad")


def decode_trendbars(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Relative OHLC rows to native bars; ``issues`` tells why a row is refused.

    ``symbols`` holds one row per instrument (scale, name) and is joined without a hint:
    the optimiser broadcasts it when its size allows.
    """
    r = raw.join(symbols, "symbol_id", "left")
    px = lambda d: (F.col("low") + d) / F.col("price_scale")
    period = F.coalesce("period_seconds", "response_period", "requested_period")
    rows = r.withColumns({
        "tf_seconds": period, "start": F.timestamp_seconds(F.col("start_minutes") * 60),
        "o": px(F.col("delta_open")), "h": px(F.col("delta_high")), "l": px(F.lit(0)), "c": px(F.col("delta_close")),
    })
    rows = rows.withColumn("end", plus_seconds("start", F.col("tf_seconds")))
    agree = lambda a: F.col(a).isNull() | (F.col(a) == F.col("tf_seconds"))
    issues = codes([
        ("unknown_symbol", F.col("price_scale").isNull()),
        (
            "incomplete",
            F.col("low").isNull() | F.col("delta_open").isNull() | F.col("delta_high").isNull()
            | F.col("delta_close").isNull() | F.col("start_minutes").isNull() | F.col("protocol_volume").isNull(),
        ),
        ("period_unknown", F.col("tf_seconds").isNull()),
        ("period_mismatch", ~(agree("period_seconds") & agree("response_period") & agree("requested_period"))),
        ("ohlc_incoherent", (F.col("h") < F.greatest("o", "c", "l")) | (F.col("l") > F.least("o", "c", "h"))),
        ("volume_negative", F.col("protocol_volume") < 0),
    ])
    known = F.coalesce("available_at", "received_at")
    return rows.select(
        "instrument", "tf_seconds", "start", "end", F.col("o").alias("open"), F.col("h").alias("high"),
        F.col("l").alias("low"), F.col("c").alias("close"), F.lit(None).cast("double").alias("volume"),
        "protocol_volume", known.alias("available_at"), F.coalesce(known >= F.col("end"), F.lit(False)).alias("closed"),
        issues.alias("issues"),
    )
