"""Trend-pullback rule over three timeframes, as running windows over one merged stream.

All three bar series of an instrument are merged in the order in which they became
known: context before preparation before trigger at the same instant. The life of an
episode needs no row loop: the newest preparation is a running last value, invalidation
is a changed count of contrary context rows since then, and use is "not the first
qualifying trigger of the episode". The merged stream holds bars only, so its length per
instrument is bounded by the time span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import plus_seconds
from tickloom.operators.bars import is_valid_bar, series
from tickloom.operators.signals import context_direction, signal_id

FULFILLED, FAILED, UNKNOWN, DISABLED = "FULFILLED", "FAILED", "UNKNOWN", "DISABLED"


@dataclass(frozen=True)
class TrendRule:
    context_lag: int = 3
    preparation_lag: int = 3
    max_distance_atr: float = 0.5
    rsi_threshold: float = 50.0
    ttl_bars: int = 3


def _state(known: Column, passed: Column) -> Column:
    return F.when(~known, UNKNOWN).when(passed, FULFILLED).otherwise(FAILED)


def _preparation_features(points: DataFrame, lag: int) -> DataFrame:
    w = series()
    rows = points.withColumn("_ok", is_valid_bar())
    return rows.withColumns({
        "_close_lag": F.lag("close", lag).over(w), "_lag_avail": F.lag("available_at", lag).over(w),
        "_lag_ok": F.lag("_ok", lag).over(w),
    }).withColumn("_known_at", F.greatest("available_at", "_lag_avail"))


def _trigger_features(points: DataFrame) -> DataFrame:
    w = series()
    rows = points.withColumn("_ok", is_valid_bar())
    return rows.withColumns({
        "_pc": F.lag("close").over(w), "_pe": F.lag("ema_fast").over(w), "_pend": F.lag("end").over(w),
        "_pok": F.lag("_ok").over(w),
    })


def merged_stream(context: DataFrame, preparation: DataFrame, trigger: DataFrame, rule: TrendRule) -> DataFrame:
    """The three indicator series in causal order, with running context columns."""
    c = context_direction(context, rule.context_lag).select(
        "instrument", F.col("context_available").alias("_at"), F.lit(0).alias("_stage"), "start", "end",
        F.struct(
            F.col("context_direction").alias("dir"), F.col("context_known").alias("known"), F.col("start").alias("start"),
        ).alias("_ctx_row"),
    )
    p = _preparation_features(preparation, rule.preparation_lag).select(
        "instrument", F.col("_known_at").alias("_at"), F.lit(1).alias("_stage"), "start", "end", "close", "ema_fast",
        "atr", "_ok", "_close_lag", "_lag_ok", "_lag_avail",
    )
    t = _trigger_features(trigger).select(
        "instrument", F.col("available_at").alias("_at"), F.lit(2).alias("_stage"), "start", "end", "close",
        "ema_fast", "rsi", "_ok", "_pc", "_pe", "_pend", "_pok",
    )
    rows = c.unionByName(p, allowMissingColumns=True).unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy("instrument").orderBy("_at", "_stage", "start").rowsBetween(Window.unboundedPreceding, 0)
    is_ctx = F.col("_stage") == 0
    contrary = lambda d: is_ctx & ~F.coalesce((F.col("_ctx_row.dir") == d) & F.col("_ctx_row.known"), F.lit(False))
    return rows.withColumns({
        "ctx": F.last("_ctx_row", ignorenulls=True).over(w),
        "_not_up": F.count_if(contrary("UP")).over(w),
        "_not_down": F.count_if(contrary("DOWN")).over(w),
    })


def evaluate(
    context: DataFrame, preparation: DataFrame, trigger: DataFrame, *,
    preparation_seconds: int, rule: TrendRule = TrendRule(),
) -> DataFrame:
    """One evaluation per preparation and trigger bar, with its condition array.

    Columns: instrument, stage, start, end, available_at, direction, decision, reasons,
    conditions (array of name/state/reason structs), episode_start, signal_id.
    """
    rows = merged_stream(context, preparation, trigger, rule)
    ctx_dir, ctx_known = F.col("ctx.dir"), F.coalesce(F.col("ctx.known"), F.lit(False))
    prep, trig = F.col("_stage") == 1, F.col("_stage") == 2
    never = F.lit(False)

    # preparation bars
    lag_known = F.col("_ok") & F.coalesce(F.col("_lag_ok"), never) & F.col("_close_lag").isNotNull()
    moved = F.when(ctx_dir == "UP", F.col("close") < F.col("_close_lag")).when(
        ctx_dir == "DOWN", F.col("close") > F.col("_close_lag")
    )
    near_known = lag_known & F.col("ema_fast").isNotNull() & F.col("atr").isNotNull()
    near = F.abs(F.col("close") - F.col("ema_fast")) <= rule.max_distance_atr * F.col("atr")
    rows = rows.withColumns({
        "_c_context": F.when(ctx_dir.isNotNull(), FULFILLED).when(ctx_known, FAILED).otherwise(UNKNOWN),
        "_c_pull": _state(lag_known, F.coalesce(moved, never)),
        "_c_near": _state(near_known, F.coalesce(near, never)),
        "_c_quality": F.when(F.col("_ok"), FULFILLED).otherwise(UNKNOWN),
    })
    registered = prep
    for c in ("_c_context", "_c_pull", "_c_near", "_c_quality"):
        registered = registered & (F.col(c) == FULFILLED)
    episode = F.when(
        registered,
        F.struct(
            F.col("start").alias("start"), ctx_dir.alias("dir"), F.col("_at").alias("at"),
            plus_seconds("_at", rule.ttl_bars * preparation_seconds).alias("expires"),
            F.when(ctx_dir == "UP", F.col("_not_up")).otherwise(F.col("_not_down")).alias("contrary"),
        ),
    )
    order = Window.partitionBy("instrument").orderBy("_at", "_stage", "start")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_registered", registered).withColumn("_ep_row", episode)
    rows = rows.withColumn("_ep", F.last("_ep_row", ignorenulls=True).over(w))

    # life of the newest episode at each trigger
    now_contrary = F.when(F.col("_ep.dir") == "UP", F.col("_not_up")).otherwise(F.col("_not_down"))
    rows = rows.withColumn("_invalid", F.coalesce(now_contrary > F.col("_ep.contrary"), never))
    rows = rows.withColumn("_late", F.coalesce(F.col("_at") >= F.col("_ep.expires"), never))
    live = F.col("_ep").isNotNull() & ~F.col("_invalid") & ~F.col("_late")
    rows = rows.withColumn("_live", live)
    direction = F.when(live, F.col("_ep.dir")).otherwise(ctx_dir)
    rows = rows.withColumn("_dir", F.when(trig, direction).otherwise(ctx_dir))
    d = F.col("_dir")
    confirmed = d.isNotNull() & (ctx_dir == d)
    cross_known = (
        d.isNotNull() & F.col("_ok") & F.col("ema_fast").isNotNull() & F.coalesce(F.col("_pok"), never)
        & F.col("_pe").isNotNull() & F.coalesce(F.col("_pend") == F.col("start"), never)
    )
    crossed = F.when(
        d == "UP", (F.col("_pc") <= F.col("_pe")) & (F.col("close") > F.col("ema_fast"))
    ).otherwise((F.col("_pc") >= F.col("_pe")) & (F.col("close") < F.col("ema_fast")))
    rsi_ok = F.when(d == "UP", F.col("rsi") > rule.rsi_threshold).otherwise(F.col("rsi") < rule.rsi_threshold)
    rows = rows.withColumns({
        "_t_context": F.when(F.coalesce(confirmed, never), FULFILLED).when(~ctx_known, UNKNOWN).otherwise(FAILED),
        "_t_cross": _state(cross_known, F.coalesce(crossed, never)),
        "_t_rsi": _state(d.isNotNull() & F.col("rsi").isNotNull() & F.col("_ok"), F.coalesce(rsi_ok, never)),
    })
    complete = trig & F.col("_live") & (F.col("_c_quality") == FULFILLED)
    for c in ("_t_context", "_t_cross", "_t_rsi"):
        complete = complete & (F.col(c) == FULFILLED)
    rows = rows.withColumn("_complete", complete)
    per_episode = Window.partitionBy("instrument", "_ep.start", "_ep.at").orderBy("_at", "_stage", "start")
    before = per_episode.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_used": F.coalesce(F.max(F.col("_complete").cast("int")).over(before), F.lit(0)) == 1,
        # Only the first trigger that meets an expired episode reports the expiry.
        "_expired_first": trig & F.col("_late") & ~F.col("_invalid") & (
            F.coalesce(F.max((trig & F.col("_late")).cast("int")).over(before), F.lit(0)) == 0
        ),
    })
    used = F.col("_used") & F.col("_live")
    ep_state = (
        F.when(F.col("_live") & ~used, FULFILLED).when(used | F.col("_expired_first"), FAILED).otherwise(UNKNOWN)
    )
    ctx_lost = F.col("_t_context") == FAILED
    ep_reason = (
        F.when(used, "signal_duplicate").when(F.col("_live"), None).when(F.col("_expired_first"), "preparation_expired")
        .when(ctx_lost, "context_invalidated").otherwise("preparation_not_registered")
    )
    rows = rows.withColumns({"_t_episode": ep_state, "_r_episode": ep_reason})

    def cond(name: str, state: Column, reason: Column) -> Column:
        mandatory = name != "news_filter"
        return F.struct(
            F.lit(name).alias("name"), state.alias("state"), reason.alias("reason"), F.lit(mandatory).alias("mandatory")
        )

    def why(c: str, unknown: Column | str, failed: str) -> Column:
        u = F.lit(unknown) if isinstance(unknown, str) else unknown
        return F.when(F.col(c) == UNKNOWN, u).when(F.col(c) == FAILED, failed)

    missing_ctx = F.when(F.col("ctx").isNull(), "context_not_available").otherwise("context_indicator_not_ready")
    prep_input = F.when(~F.col("_ok"), "preparation_quality_blocked").otherwise("preparation_lookback_insufficient")
    quality = cond("data_quality", F.col("_c_quality"), why("_c_quality", "data_quality_blocked", ""))
    news = cond("news_filter", F.lit(DISABLED), F.lit("not_configured"))
    prep_conditions = F.array(
        cond("context_direction", F.col("_c_context"), why("_c_context", missing_ctx, "context_neutral")),
        cond("pullback", F.col("_c_pull"), why("_c_pull", prep_input, "directional_pullback_failed")),
        cond(
            "distance_to_ema", F.col("_c_near"),
            why("_c_near", F.when(lag_known, "ema_or_atr_not_ready").otherwise(prep_input), "distance_exceeded"),
        ),
        quality, news,
    )
    trigger_conditions = F.array(
        cond("context_revalidated", F.col("_t_context"), why("_t_context", missing_ctx, "context_invalidated")),
        cond("preparation_episode", F.col("_t_episode"), F.col("_r_episode")),
        cond(
            "close_cross_ema", F.col("_t_cross"),
            why(
                "_t_cross",
                F.when(F.col("_dir").isNull(), "direction_not_known")
                .when(~F.col("_ok") | F.col("ema_fast").isNull(), "trigger_indicator_not_ready")
                .otherwise("trigger_previous_bar_unavailable"),
                "no_directional_cross",
            ),
        ),
        cond("rsi_threshold", F.col("_t_rsi"), why("_t_rsi", "rsi_not_ready", "rsi_threshold_failed")),
        quality, news,
    )
    out = rows.where(prep | trig).withColumn(
        "conditions", F.when(prep, prep_conditions).otherwise(trigger_conditions)
    )
    mandatory = F.filter("conditions", lambda c: c["mandatory"])
    barred = F.exists(
        mandatory,
        lambda c: F.coalesce(c["reason"], F.lit("")).isin("preparation_expired", "context_invalidated", "signal_duplicate"),
    )
    unknown = F.exists(mandatory, lambda c: c["state"] == UNKNOWN)
    failed = F.exists(mandatory, lambda c: c["state"] == FAILED)
    decision = (
        F.when(barred | unknown, "blocked").when(failed, "discarded").when(prep, "preparation").otherwise("signal")
    )
    reasons = F.array_distinct(
        F.filter(F.transform("conditions", lambda c: c["reason"]), lambda r: r.isNotNull() & (r != ""))
    )
    ep_start = F.when(F.col("_registered"), F.col("start")).when(trig & F.col("_live"), F.col("_ep.start"))
    out = out.withColumns({"decision": decision, "reasons": reasons, "episode_start": ep_start})
    sid = signal_id(
        "sig_", F.lit("trend_pullback"), "instrument", F.unix_micros("episode_start").cast("string"),
        F.unix_micros("start").cast("string"),
    )
    return out.select(
        "instrument", F.when(prep, "preparation").otherwise("trigger").alias("stage"), "start", "end",
        F.col("_at").alias("available_at"), F.col("_dir").alias("direction"), "decision", "reasons", "conditions",
        "episode_start", F.col("ctx.start").alias("context_start"),
        F.when(F.col("decision") == "signal", sid).alias("signal_id"),
    )


def signals(evaluations: DataFrame) -> DataFrame:
    return evaluations.where(F.col("decision") == "signal").select(
        "signal_id", "instrument", "direction", F.col("available_at").alias("detected_at"),
        F.lit("trend_pullback").alias("strategy"), "start", "episode_start", "context_start",
    )
