"""EMA, RSI and ATR over bars, with correct warm-up after gaps, as window expressions.

Every smoothing here is y_i = a·y_(i−1) + u_i. Inside a block of ``BLOCK`` bars it equals
a^p · Σ u·a^(−p), a running sum of one sign, so no per-row Python is needed; blocks are
linked by their last values, weighted with a^BLOCK per step. ``GROUP`` blocks form a larger
block that is linked in the same way, and so on for ``LEVELS``; the uppermost level looks back
to the start of the segment. No block is left out, whatever the period.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.calendar import covers_closed
from tickloom.functions.columns import finite
from tickloom.operators.bars import BAR_KEYS, is_valid_bar, series

BLOCK = 256
GROUP = 64
LEVELS = 2


@dataclass(frozen=True)
class Periods:
    ema_fast: int = 20
    ema_slow: int = 50
    rsi: int = 14
    atr: int = 14


def warmup_segments(bars: DataFrame, *, use_calendar: bool = False) -> DataFrame:
    """Mark the bars that may feed an indicator and number the unbroken runs of them.

    ``segment`` changes at every bar that is open, invalid or not adjacent to the bar
    before; ``sample`` counts the eligible bars of a segment from 1.
    """
    w = series()
    usable = is_valid_bar() & finite("high") & finite("low") & finite("close")
    prev_closed, prev_end = F.lag("closed").over(w), F.lag("end").over(w)
    rows = bars.withColumns({"_usable": usable, "_prev_closed": prev_closed, "_prev_end": prev_end})
    joined = F.col("start") == F.col("_prev_end")
    if use_calendar:
        joined = joined | covers_closed("_prev_end", "start")
    free = ~F.coalesce(F.col("_prev_closed"), F.lit(False))
    rows = rows.withColumn("eligible", F.col("_usable") & (free | F.coalesce(joined, F.lit(False))))
    rows = rows.withColumn("segment", F.sum((~F.col("eligible")).cast("int")).over(w))
    run = Window.partitionBy(*BAR_KEYS, "segment").orderBy("start")
    rows = rows.withColumn("sample", F.when(F.col("eligible"), F.sum(F.col("eligible").cast("int")).over(run)))
    return rows.drop("_usable", "_prev_closed", "_prev_end")


def _decay(n: int, wilder: bool) -> float:
    return (n - 1) / n if wilder else 1 - 2 / (n + 1)


def _carried(ends: DataFrame, weights: dict[str, float], levels: int) -> DataFrame:
    """What all blocks before a block carry into it: ``_c_<name>`` for rows (series, segment, _block, _end)."""
    keys = [*BAR_KEYS, "segment"]

    def fold(values: Column, k: str) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, e: acc * F.lit(weights[k]) + e[f"_l_{k}"])

    if not levels:
        back = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        rows = ends.withColumn("_ends", F.collect_list("_end").over(back))
        return rows.select(*keys, "_block", *[fold(F.col("_ends"), k).alias(f"_c_{k}") for k in weights])
    rows = ends.withColumn("_upper", F.floor(F.col("_block") / GROUP))
    inside = Window.partitionBy(*keys, "_upper").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ends", F.collect_list("_end").over(inside))  # fewer than GROUP
    whole = rows.groupBy(*keys, "_upper").agg(F.max_by(F.struct("_ends", "_end"), "_block").alias("_all"))
    tops = whole.select(
        *keys, F.col("_upper").alias("_block"),
        F.struct(*[fold(F.concat("_all._ends", F.array("_all._end")), k).alias(f"_l_{k}") for k in weights]).alias("_end"),
    )
    above = _carried(tops, {k: w**GROUP for k, w in weights.items()}, levels - 1).withColumnRenamed("_block", "_upper")
    above = above.select(*keys, "_upper", *[F.col(f"_c_{k}").alias(f"_a_{k}") for k in weights])
    pos = F.col("_block") - F.col("_upper") * GROUP
    return rows.join(above, [*keys, "_upper"], "left").select(
        *keys, "_block", *[(fold(F.col("_ends"), k) + F.pow(F.lit(w), pos) * F.col(f"_a_{k}")).alias(f"_c_{k}") for k, w in weights.items()]
    )


def _smooth(rows: DataFrame, specs: dict[str, tuple[str, int, int, float]]) -> DataFrame:
    """Add smoothed columns; ``specs`` maps name → (value, samples before, period, decay)."""
    run = Window.partitionBy(*BAR_KEYS, "segment").orderBy("start")
    block = Window.partitionBy(*BAR_KEYS, "segment", "_block").orderBy("start")
    rows = rows.withColumns({
        "_block": F.floor((F.col("sample") - 1) / BLOCK),
        "_pos": F.pmod(F.col("sample") - 1, F.lit(BLOCK)),
    })
    rows = rows.withColumns({f"_t_{k}": F.sum(v).over(run) for k, (v, _, _, _) in specs.items()})
    inputs, local = {}, {}
    for k, (value, skip, n, a) in specs.items():
        nth = F.col("sample") - skip
        u = F.when(nth == n, F.col(f"_t_{k}") / n).when(nth > n, (1 - a) * F.col(value)).otherwise(F.lit(0.0))
        inputs[f"_u_{k}"] = F.when(F.col("eligible"), u)
        if a > 0:
            local[f"_l_{k}"] = F.sum(F.col(f"_u_{k}") * F.pow(F.lit(a), -F.col("_pos"))).over(block) * F.pow(
                F.lit(a), F.col("_pos")
            )
        else:
            local[f"_l_{k}"] = F.col(f"_u_{k}")
    rows = rows.withColumns(inputs).withColumns(local)
    ends = rows.where("eligible").groupBy(*BAR_KEYS, "segment", "_block").agg(
        F.max_by(F.struct(*[F.col(f"_l_{k}") for k in specs]), "sample").alias("_end")
    )
    carried = _carried(ends, {k: spec[3] ** BLOCK for k, spec in specs.items()}, LEVELS)
    links = carried.select(*BAR_KEYS, "segment", "_block", *[F.col(f"_c_{k}").alias(f"_y_{k}") for k in specs])
    out = rows.join(links, [*BAR_KEYS, "segment", "_block"], "left")
    for k, (_, skip, n, a) in specs.items():
        y = F.col(f"_l_{k}") + F.lit(a) * F.pow(F.lit(a), F.col("_pos")) * F.col(f"_y_{k}") if a > 0 else F.col(f"_l_{k}")
        out = out.withColumn(k, F.when(F.col("eligible") & (F.col("sample") - skip >= n), y))
    return out.drop("_block", "_pos", *[f"_{p}_{k}" for k in specs for p in "tuly"])


def add_indicators(bars: DataFrame, periods: Periods = Periods(), *, use_calendar: bool = False) -> DataFrame:
    """Bars plus ema_fast, ema_slow, rsi, atr (NULL while not ready) and ``ready``."""
    rows = warmup_segments(bars, use_calendar=use_calendar)
    run = Window.partitionBy(*BAR_KEYS, "segment").orderBy("start")
    first = F.col("sample") == 1
    rows = rows.withColumn("_pc", F.when(~first, F.lag("close").over(run)))
    change = F.col("close") - F.col("_pc")
    span = F.col("high") - F.col("low")
    rows = rows.withColumns({
        "_px": F.when(F.col("eligible"), F.col("close")),
        "_up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
        "_down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        "_tr": F.when(first, span).when(
            F.col("eligible"),
            F.greatest(span, F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))),
        ),
    })
    p = periods
    out = _smooth(rows, {
        "ema_fast": ("_px", 0, p.ema_fast, _decay(p.ema_fast, False)),
        "ema_slow": ("_px", 0, p.ema_slow, _decay(p.ema_slow, False)),
        "_gain": ("_up", 1, p.rsi, _decay(p.rsi, True)),
        "_loss": ("_down", 1, p.rsi, _decay(p.rsi, True)),
        "atr": ("_tr", 0, p.atr, _decay(p.atr, True)),
    })
    gain, loss = F.col("_gain"), F.col("_loss")
    rsi = (
        F.when(gain.isNull(), None)
        .when((loss == 0) & (gain == 0), 50.0)
        .when(loss == 0, 100.0)
        .when(gain == 0, 0.0)
        .otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    )
    out = out.withColumn("rsi", rsi)
    ready = F.lit(True)
    for c in ("ema_fast", "ema_slow", "rsi", "atr"):
        ready = ready & F.col(c).isNotNull()
    return out.withColumn("ready", ready).drop("_pc", "_px", "_up", "_down", "_tr", "_gain", "_loss")


def atr_relative() -> Column:
    """ATR divided by the absolute close of a usable bar."""
    return F.when(is_valid_bar() & (F.col("close") != 0), F.col("atr") / F.abs("close"))


def volatility_threshold(points: DataFrame, train: Column, q: float, keys: list[str]) -> DataFrame:
    """Order statistic ⌊q·(n−1)⌋ of ATR/|close| over the training rows of each key.

    Ranking runs over bars, so a key's length is bounded by its time span.
    """
    rows = points.where(train).withColumn("_ratio", atr_relative()).where(F.col("_ratio").isNotNull())
    w = Window.partitionBy(*keys)
    ranked = rows.select(
        *keys, "_ratio", (F.row_number().over(w.orderBy("_ratio")) - 1).alias("_rank"),
        F.count(F.lit(1)).over(w).alias("sample_count"),
    )
    hit = ranked.where(F.col("_rank") == F.floor(F.lit(q) * (F.col("sample_count") - 1)))
    return hit.select(*keys, F.col("_ratio").alias("threshold"), "sample_count")


def volatility_regime(ratio: Column, threshold: Column) -> Column:
    return F.when(ratio.isNull() | threshold.isNull(), None).when(ratio < threshold, "LOW").otherwise("HIGH")


def ema_slope() -> Column:
    """Change of the fast EMA against the adjacent previous bar, in ATRs."""
    w = series()
    prev = lambda c: F.lag(c).over(w)
    ok = (
        (prev("end") == F.col("start"))
        & (prev("available_at") <= F.col("available_at"))
        & is_valid_bar()
        & (F.col("atr") > 0)
    )
    return F.when(ok & F.col("_valid_prev"), (F.col("ema_fast") - prev("ema_fast")) / F.col("atr"))


def add_features(points: DataFrame) -> DataFrame:
    """ATR/|close|, EMA slope in ATRs and UTC session per bar (spread comes by as-of join)."""
    from tickloom.functions.columns import session_label

    rows = points.withColumn("_valid", is_valid_bar())
    rows = rows.withColumn("_valid_prev", F.lag("_valid").over(series()))
    return rows.withColumns({
        "atr_relative": atr_relative(), "ema_slope": ema_slope(),
        "session": F.when(F.col("available_at").isNotNull(), session_label("end")),
    }).drop("_valid", "_valid_prev")
