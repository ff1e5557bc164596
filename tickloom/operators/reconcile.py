"""Native bars against rebuilt ones, and alignment of candidates on common blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import day_block, near

KEYS = ["instrument", "tf_seconds", "start"]
FIELDS = ("open", "high", "low", "close")


def _one_per_interval(bars: DataFrame, tag: str) -> DataFrame:
    """Copies of an interval combine on the map side; their number is kept."""
    return bars.groupBy(*KEYS).agg(
        *[F.min(f).alias(f"{tag}_{f}") for f in FIELDS], F.count(F.lit(1)).alias(f"{tag}_copies"),
        F.bool_and("closed").alias(f"{tag}_closed"),
    )


def reconcile_bars(native: DataFrame, rebuilt: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """MATCH, MISMATCH, MISSING_NATIVE, MISSING_EVENTS or BLOCKED per interval, with reasons."""
    both = _one_per_interval(native, "n").join(_one_per_interval(rebuilt, "r"), KEYS, "full_outer")
    copies = (F.coalesce("n_copies", F.lit(1)) > 1) | (F.coalesce("r_copies", F.lit(1)) > 1)
    opened = ~F.coalesce("n_closed", F.lit(True)) | ~F.coalesce("r_closed", F.lit(True))
    differ = F.array_compact(F.array(*[
        F.when(~near(f"n_{f}", f"r_{f}", tolerance), F.lit(f)) for f in FIELDS
    ]))
    blocked = F.when(copies, "duplicate").when(opened, "open_bar")
    out = both.withColumns({"_blocked": blocked, "_differ": differ})
    state = (
        F.when(F.col("_blocked").isNotNull(), "BLOCKED").when(F.col("n_copies").isNull(), "MISSING_NATIVE")
        .when(F.col("r_copies").isNull(), "MISSING_EVENTS").when(F.size("_differ") > 0, "MISMATCH").otherwise("MATCH")
    )
    reasons = F.when(F.col("_blocked").isNotNull(), F.array("_blocked")).otherwise(F.col("_differ"))
    return out.select(*KEYS, state.alias("state"), reasons.alias("reasons"))


def common_blocks(rows: DataFrame, candidate: str, at: str, width: int) -> DataFrame:
    """Calendar blocks in which every candidate has at least one row."""
    pairs = rows.select(candidate, day_block(F.to_date(at), width).alias("block")).distinct()
    total = rows.agg(F.count_distinct(candidate)).scalar()
    return pairs.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == total).select("block")
