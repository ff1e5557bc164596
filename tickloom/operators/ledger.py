"""Trade-ledger statistics in which an unknown value stays unknown.

Everything combines on the map side; order-dependent figures (drawdown) use ranged scans,
so one variant may hold all the trades.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import seconds_between
from tickloom.operators.scan import CHUNK, exact_quantiles, neighbour, range_chunks

UNKNOWN = "UNKNOWN"


def total_if_known(value: str) -> Column:
    """Sum, or NULL when any input is unknown."""
    return F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(value))


def net_metrics(trades: DataFrame, keys: Sequence[str], value: str = "net") -> DataFrame:
    known = F.count(value)
    unknown = F.count_if(F.col(value).isNull())
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), known.alias("known"), unknown.alias("unknown"),
        total_if_known(value).alias("net"), F.sum(value).alias("known_net"),
        F.when(unknown == 0, F.try_divide(F.sum(value).cast("double"), known)).alias("expectancy"),
        F.try_divide(F.sum(value).cast("double"), known).alias("known_expectancy"),
        F.when(known == 0, "NOT_ASSESSED").when(unknown == 0, "ASSESSED").otherwise("PARTIAL_NOT_ASSESSED").alias("status"),
    )


def equity_curve(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, at: str, *, level: bool = False) -> DataFrame:
    """Equity, running peak, drawdown, and the drawdown before each row.

    ``value`` is a change to be accumulated, with a starting peak of zero, or with
    ``level`` the equity itself, whose peak starts at the first mark.

    Inside a range both running totals are local; one summary row per range (its total and
    its local peak) gives the equity and the peak with which the next range starts.
    """
    by = [*keys, CHUNK]
    chunked = range_chunks(rows.where(F.col(value).isNotNull()), keys, order)
    inner = Window.partitionBy(*by).orderBy(*order)
    to_here = inner.rowsBetween(Window.unboundedPreceding, 0)
    local = F.col(value) if level else F.sum(value).over(to_here)
    work = chunked.withColumn("_c", local)
    mark = F.struct(F.col("_c").alias("v"), (-F.unix_micros(at)).alias("t"))  # the earliest of equal peaks
    work = work.withColumn("_m", F.max(mark).over(to_here))

    summary = work.groupBy(*by).agg(
        F.max(mark).alias("_top"), (F.max_by("_c", F.struct(*order)) if level else F.sum(value)).alias("_total")
    )
    ranges = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    if level:
        carry = summary.withColumns({"_zero": F.lit(0), "_before": F.lag("_total").over(ranges)})
    else:
        carry = summary.withColumn("_zero", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        carry = carry.withColumn("_before", F.col("_zero"))
    lifted = F.struct((F.col("_top.v") + F.col("_zero")).alias("v"), F.col("_top.t").alias("t"))
    carry = carry.withColumn("_lifted", lifted)
    carry = carry.withColumn("_peak", F.max("_lifted").over(earlier)).select(*by, "_zero", "_before", "_peak")

    out = work.join(carry, by)
    kind = carry.schema["_peak"].dataType["v"].dataType
    here = F.struct((F.col("_m.v") + F.col("_zero")).cast(kind).alias("v"), F.col("_m.t").alias("t"))
    out = out.withColumns({"equity": F.col("_c") + F.col("_zero"), "_run": F.greatest(here, "_peak")})

    def peak_of(top: str) -> Column:
        return F.col(f"{top}.v") if level else F.greatest(F.col(f"{top}.v"), F.lit(0))

    def peak_time(top: str) -> Column:
        when = F.timestamp_micros(-F.col(f"{top}.t"))
        return when if level else F.when(F.col(f"{top}.v") > 0, when)

    first = F.row_number().over(inner) == 1
    out = out.withColumns({
        "peak": peak_of("_run"), "peak_at": peak_time("_run"), "_first": first,
        "_lag": F.lag(F.struct("equity", "_run")).over(inner),
    })
    start_gap = F.coalesce(peak_of("_peak"), F.lit(0)) - F.col("_before")
    lag_peak = F.col("_lag._run.v") if level else F.greatest(F.col("_lag._run.v"), F.lit(0))
    lag_time = F.timestamp_micros(-F.col("_lag._run.t"))
    lag_time = lag_time if level else F.when(F.col("_lag._run.v") > 0, lag_time)
    return out.withColumns({
        "drawdown": F.col("peak") - F.col("equity"),
        "drawdown_before": F.when(F.col("_first"), start_gap).otherwise(lag_peak - F.col("_lag.equity")),
        "peak_at_before": F.when(F.col("_first"), peak_time("_peak")).otherwise(lag_time),
    }).drop("_c", "_m", "_zero", "_before", "_peak", "_run", "_first", "_lag")


def drawdown_summary(curve: DataFrame, keys: Sequence[str], order: Sequence[str], at: str) -> DataFrame:
    """Largest drawdown with its peak and trough, recoveries, and the open spell if any."""
    recovered = (F.col("drawdown") == 0) & (F.col("drawdown_before") > 0)
    near = curve.withColumn("_rec", F.when(recovered, seconds_between("peak_at_before", at)))
    last = F.max_by(F.struct(F.col("drawdown").alias("d"), F.col("peak_at").alias("p"), F.col(at).alias("t")), F.struct(*order))
    worst_order = F.struct(F.col("drawdown"), -F.unix_micros(at))
    out = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("marks"),
        F.max("drawdown").alias("max_drawdown"),
        F.max_by(F.struct("peak_at", F.col(at).alias("trough_at")), worst_order).alias("_worst"),
        F.max("_rec").alias("_longest"), last.alias("_last"),
    )
    open_ = F.col("_last.d") > 0
    hurt = F.col("max_drawdown") > 0
    return out.select(
        *keys, "marks", "max_drawdown", F.when(hurt, F.col("_worst.peak_at")).alias("peak_at"),
        F.when(hurt, F.col("_worst.trough_at")).alias("trough_at"),
        F.when(~open_, F.coalesce("_longest", F.lit(0.0))).alias("recovery_seconds"),
        F.when(open_, "UNRECOVERED").otherwise("RECOVERED").alias("recovery_state"),
        F.when(open_, F.col("_last.p")).alias("unrecovered_since"),
        F.when(open_, seconds_between("_last.p", "_last.t")).otherwise(F.lit(0.0)).alias("unrecovered_seconds"),
    )


def daily_net(trades: DataFrame, observed_days: DataFrame, keys: Sequence[str], *, at: str = "close_at", value: str = "net") -> DataFrame:
    """Net per observed day; a day without trades is zero, an unobserved day is absent."""
    per_day = trades.groupBy(*keys, F.to_date(at).alias("day")).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col(value).isNull()).alias("unknown"), F.sum(value).alias("known_net")
    )
    grid = observed_days.select(*keys, "day").distinct()
    joined = grid.join(per_day, [*keys, "day"], "full_outer")
    unknown = F.coalesce("unknown", F.lit(0))
    return joined.select(
        *keys, "day", F.coalesce("trades", F.lit(0)).alias("trades"), unknown.alias("unknown"),
        F.coalesce("known_net", F.lit(0)).alias("known_net"),
        F.when(unknown == 0, F.coalesce("known_net", F.lit(0))).alias("net"),
    )


def cost_bridge(trades: DataFrame, keys: Sequence[str], components: Sequence[str] = ()) -> DataFrame:
    """Gross to net with each missing side derived from the other two, and the rest unknown."""
    gross = F.coalesce(F.col("gross"), F.col("net") + F.col("cost"))
    net = F.coalesce(F.col("net"), F.col("gross") - F.col("cost"))
    cost = F.coalesce(F.col("cost"), F.col("gross") - F.col("net"))
    work = trades.withColumns({"_g": gross, "_n": net, "_c": cost})
    explicit = F.lit(0)
    for c in components:
        explicit = explicit + F.coalesce(F.col(c), F.lit(0))
    work = work.withColumn("other", F.col("_c") - explicit)
    parts = [*components, "other"]
    aggs = []
    for name, c in (("gross", "_g"), ("cost", "_c"), ("net", "_n")):
        aggs += [total_if_known(c).alias(name), F.sum(c).alias(f"known_{name}"), F.count_if(F.col(c).isNull()).alias(f"unknown_{name}")]
    for c in parts:
        aggs += [F.sum(c).alias(f"known_{c}" if c == "other" else f"total_{c}")]
    complete = F.count_if(F.col("_g").isNull() | F.col("_c").isNull() | F.col("_n").isNull()) == 0
    return work.groupBy(*keys).agg(F.count(F.lit(1)).alias("closed"), *aggs, complete.alias("complete"))


def concentration(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Herfindahl index of the absolute shares, from two plain sums."""
    x = F.abs(F.col(value).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(value).alias("parts"), F.try_divide(F.sum(x * x), F.pow(F.sum(x), F.lit(2))).alias("hhi")
    )


def worst_day(days: DataFrame, keys: Sequence[str], value: str = "known_net") -> DataFrame:
    return days.groupBy(*keys).agg(
        F.min_by("day", F.struct(value, "day")).alias("worst_day"), F.min(value).alias("worst_net")
    )


def turnover(trades: DataFrame, keys: Sequence[str], *, entry: str, close: str, units: str, currency: str) -> DataFrame:
    """Traded notional on both sides, its executions, and whether one currency holds."""
    sides = F.array(F.abs(F.col(entry) * F.col(units)), F.abs(F.col(close) * F.col(units)))
    flat = trades.withColumn("_side", F.explode(sides))
    return flat.groupBy(*keys).agg(
        F.sum("_side").alias("known_turnover"), total_if_known("_side").alias("turnover"),
        F.count("_side").alias("executions"), F.count_if(F.col("_side").isNull()).alias("unknown"),
        (F.min(currency) == F.max(currency)).alias("single_currency"),
    )


def exposure_summary(marks: DataFrame, keys: Sequence[str], *, at: str, ordinal: str, exposure: str) -> DataFrame:
    """Peak exposure (earliest on a tie), seconds exposed and exposure times seconds."""
    order = [at, ordinal]
    near = neighbour(range_chunks(marks, keys, order), keys, order, {"_next": at}, following=True)
    live = (F.col(exposure) > 0) & F.col("_next").isNotNull()
    secs = F.when(live, seconds_between(at, "_next"))
    rank = F.when(F.col(exposure).isNotNull(), F.struct(F.col(exposure), -F.unix_micros(at), -F.col(ordinal)))
    return near.withColumn("_secs", secs).groupBy(*keys).agg(
        F.max(exposure).alias("peak"), F.max_by(at, rank).alias("peak_at"),
        F.coalesce(F.sum("_secs"), F.lit(0.0)).alias("exposed_seconds"),
        F.coalesce(F.sum(F.col("_secs") * F.col(exposure)), F.lit(0.0)).alias("exposure_seconds"),
    )


def margin_level(explicit: str, equity: str, used: str) -> Column:
    return F.coalesce(F.col(explicit), F.try_divide(F.col(equity), F.nullif(F.col(used), F.lit(0.0))))


def funnel(rows: DataFrame, dims: Sequence[str], identity: Sequence[str], declared: str) -> DataFrame:
    """Unique, raw and duplicate counts per stage; declared counts are summed once per identity.

    Copies are collapsed first, so the second grouping sees one row per identity.
    """
    one = rows.groupBy(*dims, *identity).agg(F.count(F.lit(1)).alias("_raw"), F.max(declared).alias("_declared"))
    return one.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("unique"), F.sum("_raw").alias("raw"),
        (F.sum("_raw") - F.count(F.lit(1))).alias("duplicates"), F.sum("_declared").alias("declared"),
    )


def regime_session_table(trades: DataFrame, regime: str = "regime", session: str = "session") -> DataFrame:
    labelled = trades.withColumns({
        "regime_label": F.coalesce(F.col(regime), F.lit(UNKNOWN)), "session_label": F.coalesce(F.col(session), F.lit(UNKNOWN)),
    })
    return net_metrics(labelled, ["regime_label", "session_label"])


def mean_interval(rows: DataFrame, keys: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """Normal interval of the mean, with the sample deviation; NULL below two values."""
    x = F.col(value).cast("double")
    out = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    half = F.when(F.col("n") >= 2, z * F.col("sd") / F.sqrt("n"))
    return out.withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half})


def drop_best(trades: DataFrame, keys: Sequence[str], value: str, ident: str, k: int) -> DataFrame:
    """Total without the ``k`` best trades, as total minus the sum of the best.

    The best ``k`` are found in two steps (per salt, then per key), so no task ranks more
    than its share plus ``k`` rows per salt.
    """
    from tickloom.session import shuffle_width

    width = shuffle_width(trades.sparkSession)
    known = trades.where(F.col(value).isNotNull())
    salted = known.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(width)))
    best = lambda cols: F.row_number().over(Window.partitionBy(*cols).orderBy(F.desc(value), ident))
    local = salted.withColumn("_r", best([*keys, "_salt"])).where(F.col("_r") <= k)
    top = local.withColumn("_r", best(keys)).where(F.col("_r") <= k).groupBy(*keys).agg(F.sum(value).alias("_best"))
    totals = known.groupBy(*keys).agg(F.sum(value).alias("total"))
    return totals.join(top, list(keys), "left").select(*keys, "total", (F.col("total") - F.coalesce("_best", F.lit(0))).alias("without_best"))


def cost_state(trades: DataFrame, keys: Sequence[str], components: Sequence[str]) -> DataFrame:
    """Known cost sums and the reasons why the rest is unknown; rejected trades do not count."""
    work = trades.where(F.col("state") != "REJECTED").withColumn(
        "_reason", F.when(F.col("state") == "OPEN", "OPEN_NOT_SETTLED").when(F.col("cost").isNull(), "CLOSED_COST_UNKNOWN")
    )
    return work.groupBy(*keys).agg(
        *[F.sum(c).alias(f"known_{c}") for c in components], F.count("_reason").alias("unknown"),
        F.concat_ws(",", F.sort_array(F.collect_set("_reason"))).alias("reasons"),
    )


def summary_with_quantiles(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    from tickloom.operators.bars import quantile_summary

    return quantile_summary(rows, list(keys), value)


def window_medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return exact_quantiles(rows, keys, value, {"median": 0.5})
