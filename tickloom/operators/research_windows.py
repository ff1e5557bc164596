"""Research windows: expanding walk-forward folds, holdout, and who belongs to which.

Windows are configuration, a handful of rows that follow from two bounds, so they travel
as an array literal and no join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ledger import window_medians

# Four folds of a tenth each after the first 40 %, and the last 20 % held out.
FOLDS, TRAIN, TEST, HOLDOUT = 4, 0.40, 0.10, 0.20


@dataclass(frozen=True)
class ResearchWindow:
    name: str
    kind: str
    train_start: datetime
    train_end: datetime
    test_start: datetime
    test_end: datetime
    embargo_seconds: float = 0.0


def build_windows(first: datetime, last: datetime, embargo_seconds: float = 0.0) -> list[ResearchWindow]:
    span = (last - first).total_seconds()
    at = lambda f: first + timedelta(seconds=span * f)
    out = []
    for i in range(FOLDS):
        begin, end = at(TRAIN + i * TEST), at(TRAIN + i * TEST + TEST)
        out.append(ResearchWindow(f"walkforward_{i + 1}", "walkforward", first, begin, begin, end, embargo_seconds))
    cut = at(1.0 - HOLDOUT)
    out.append(ResearchWindow("holdout", "holdout", first, cut, cut, last, embargo_seconds))
    return out


def windows_for(rows: DataFrame, time: str, embargo_seconds: float = 0.0) -> list[ResearchWindow]:
    """Windows over the observed span; only the two bounds reach the driver."""
    lo, hi = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    if lo is None or lo == hi:
        raise ValueError("a split needs at least two distinct instants")
    base = datetime(1970, 1, 1)
    return build_windows(base + timedelta(microseconds=lo), base + timedelta(microseconds=hi), embargo_seconds)


def _literal(windows: Sequence[ResearchWindow]) -> Column:
    ts = lambda d: F.lit(d.isoformat(sep=" ")).cast("timestamp")
    return F.array(*[
        F.struct(
            F.lit(w.name).alias("window"), F.lit(w.kind).alias("kind"), ts(w.train_start).alias("train_start"),
            ts(w.train_end).alias("train_end"), ts(w.test_start).alias("test_start"), ts(w.test_end).alias("test_end"),
            F.lit(float(w.embargo_seconds)).alias("embargo_seconds"),
        )
        for w in windows
    ])


def per_window(rows: DataFrame, windows: Sequence[ResearchWindow]) -> DataFrame:
    return rows.withColumn("_w", F.explode(_literal(windows))).select(*rows.columns, "_w.*")


def record_counts(rows: DataFrame, time: str, windows: Sequence[ResearchWindow]) -> DataFrame:
    """Train, test and embargo record counts per window, in one pass over the rows."""
    t = F.col(time)
    tail = F.timestamp_micros(F.unix_micros("test_end") + F.round(F.col("embargo_seconds") * 1_000_000).cast("bigint"))
    wide = per_window(rows.select(time), windows)
    return wide.groupBy("window", "kind", "train_start", "train_end", "test_start", "test_end").agg(
        F.count_if(t <= F.col("test_start")).alias("train_records"),
        F.count_if((t > F.col("test_start")) & (t <= F.col("test_end"))).alias("test_records"),
        F.count_if((t > F.col("test_end")) & (t <= tail)).alias("embargo_records"),
    )


def assign_windows(trades: DataFrame, windows: Sequence[ResearchWindow], *, entry: str = "entry_at", close: str = "close_at") -> DataFrame:
    """OOS when the actual holding lies inside the test window, else PURGED."""
    wide = per_window(trades, windows)
    a, b = F.col(entry), F.col(close)
    tail = F.timestamp_micros(F.unix_micros("test_end") + F.round(F.col("embargo_seconds") * 1_000_000).cast("bigint"))
    placed = (
        F.when(a.isNull() | b.isNull(), "NOT_ASSESSED")
        .when((a < F.col("test_start")) | (b > F.col("test_end")), "PURGED").otherwise("OOS")
    )
    return wide.withColumn("placement", placed).withColumn(
        "embargoed", F.coalesce((a > F.col("test_end")) & (a <= tail), F.lit(False))
    )


def window_statistics(assigned: DataFrame, *, value: str = "net", entry: str = "entry_at", close: str = "close_at") -> DataFrame:
    free = ~F.col("embargoed")
    oos = free & (F.col("placement") == "OOS") & F.col(value).isNotNull()
    touching = (F.col(entry) <= F.col("test_end")) & (F.col(close) >= F.col("test_start"))
    x = F.when(oos, F.col(value).cast("double"))
    rows = assigned.withColumn("_x", x)
    out = rows.groupBy("window").agg(
        F.count("_x").alias("oos_trades"),
        F.count_if(free & (F.col("placement") == "PURGED") & touching).alias("purged_trades"),
        F.count_if("embargoed").alias("embargoed_trades"),
        F.count_if(F.col("placement") == "NOT_ASSESSED").alias("unknown_trades"),
        F.sum(F.when(oos, F.col(value))).alias("oos_net"), F.avg("_x").alias("oos_mean"),
    )
    return out.join(window_medians(rows, ["window"], "_x"), "window", "left")


def calendar_phase(t: Column, warmup_start: str, test_start: str, test_end: str, closed_from: str) -> Column:
    at = lambda s: F.lit(s).cast("timestamp")
    return (
        F.when(t < at(warmup_start), "OUTSIDE").when(t < at(test_start), "WARMUP_ONLY")
        .when(t < at(test_end), "WF_EVALUATION").when(t >= at(closed_from), "HOLDOUT_REJECTED").otherwise("OUTSIDE")
    )


def leakage(trades: DataFrame, *, signal_known: str, entry: str, close: str, ident: str) -> DataFrame:
    """Trades entered before their signal was known, or closed before they were entered."""
    kinds = F.array_compact(F.array(
        F.when(F.col(entry) < F.col(signal_known), "entry_before_signal_available"),
        F.when(F.col(close) < F.col(entry), "close_before_entry"),
    ))
    return trades.select(ident, F.explode(kinds).alias("kind"))
