"""Bars, resampling and gaps on hand-made rows."""

from pyspark.sql import functions as F

from helpers import at, bars, rows, ticks
from tickloom.operators import bars as B


def test_half_open_interval_and_partial_start(spark):
    df = ticks(spark, [("X", 0, 1.0, 2.0), ("X", 59.9, 3.0, 1.0), ("X", 60, 2.0, 5.0), ("X", 130, 9.0, 1.0)])
    out = rows(B.tick_bars(df, 60).select("start", "open", "high", "low", "close", "volume", "partial", "closed"), "start")
    assert out == [
        (at(0), 1.0, 3.0, 1.0, 3.0, 3.0, False, True), (at(60), 2.0, 2.0, 2.0, 2.0, 5.0, False, True),
        (at(120), 9.0, 9.0, 9.0, 9.0, 1.0, True, False),
    ]


def test_no_bar_without_ticks_and_gap_is_listed(spark):
    df = ticks(spark, [("X", 0, 1.0), ("X", 180, 2.0), ("X", 240, 2.0)])
    made = B.tick_bars(df, 60)
    assert made.count() == 3
    assert rows(B.bar_gaps(made).select("gap_start", "gap_end", "seconds"), "gap_start") == [(at(60), at(180), 120.0)]
    assert [r[0] for r in rows(B.missing_intervals(made).select("start"), "start")] == [at(60), at(120)]


def test_bar_is_known_when_the_next_one_opens(spark):
    df = ticks(spark, [("X", 0, 1.0), ("X", 75, 2.0)])
    assert rows(B.tick_bars(df, 60).select("available_at"), "start")[0] == (at(75),)


def test_continuity_bound(spark):
    seconds = [0, 20, 59, 60.5, 119.5, 180.5, 240.5, 260.5]
    df = ticks(spark, [("X", s, 1.0 + i) for i, s in enumerate(seconds)], base="bid")
    out = rows(B.quote_bars(df, 60, 90).select("start", "partial"), "start")
    assert out == [(at(0), False), (at(60), False), (at(180), True), (at(240), False)]
    tight = rows(B.quote_bars(df, 60, 30).select("start", F.array_contains("quality_flags", "gap")), "start")
    assert tight[0] == (at(0), True)


def test_price_base_is_never_replaced(spark):
    df = ticks(spark, [("X", 0, 1.0), ("X", 1, 2.0)], base="ask").withColumn("ask", F.when(F.col("seq") == 1, F.col("ask")))
    assert rows(B.tick_bars(df, 60).select("event_count", "open"), "start") == [(1, 2.0)]


def test_resample_needs_every_part(spark):
    df = bars(spark, [1, 2, 3, 4, 5, 6, 7], skip=(3,))
    out = rows(B.resample(df, 180).select("start", "open", "close", "complete"), "start")
    assert out == [(at(0), 1.0, 3.0, True), (at(180), 5.0, 6.0, False), (at(360), 7.0, 7.0, False)]


def test_latest_revision_wins(spark):
    df = bars(spark, [1, 2])
    newer = df.where(F.col("close") == 1).withColumns({"close": F.lit(9.0), "revision": F.lit(3)})
    assert [r[0] for r in rows(B.latest_revision(df.unionByName(newer)).select("close"), "start")] == [9.0, 2.0]


def test_last_contiguous_run(spark):
    df = bars(spark, list(range(10)), skip=(4,))
    out = B.last_contiguous_run(df, F.lit(at(480)), 4).first()
    assert (out["run_length"], out["run_start"], out["ready"]) == (3, at(300), False)
