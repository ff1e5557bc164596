"""Forward outcome labels of signals, and their aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import break_even, plus_seconds
from tickloom.operators.asof import BACKWARD, FORWARD, select_price
from tickloom.operators.ledger import drawdown_summary, equity_curve
from tickloom.operators.scan import fold_sorted, range_chunks, run_count, run_last, run_max, running
from tickloom.session import pin

OUTCOMES = ("WIN", "LOSS", "TIE", "INDETERMINATE", "PENDING")


@dataclass(frozen=True)
class Contract:
    """Fixed assumptions of an evaluation."""

    latency_seconds: float = 0.0
    max_age_seconds: float = 120.0
    exit_rule: str = BACKWARD
    horizon_from: str = "entry"
    tie_tolerance: float = 0.0
    stake: float = 1.0
    payout: float = 0.8
    loss: float = 1.0
    tie_net: float = 0.0
    cost: float = 0.0


def points_from_bars(bars: DataFrame) -> DataFrame:
    """Bar closes as observations usable at the bar's end."""
    return bars.where(F.col("closed")).select(
        "instrument", F.col("end").alias("event_time"), "available_at", F.col("close").alias("price"),
        F.unix_micros("start").alias("ordinal"),
        F.concat_ws(":", "instrument", F.col("tf_seconds").cast("string"), F.unix_micros("start").cast("string")).alias("point_id"),
    )


def points_from_ticks(ticks: DataFrame, price: Column) -> DataFrame:
    return ticks.select(
        "instrument", "event_time", "available_at", price.alias("price"), F.col("seq").alias("ordinal"),
        F.col("event_id").alias("point_id"),
    )


def label(
    signals: DataFrame, points: DataFrame, horizons: Sequence[float], rule: Contract = Contract(), *,
    complete: bool = True,
) -> DataFrame:
    """One row per signal and horizon with entry, final price, outcome and net.

    The entry does not depend on the horizon, so it is looked up once per signal, and pinned, as the second search reads it often.
    """
    base = signals.withColumn("_target", plus_seconds("detected_at", rule.latency_seconds))
    entered = pin(select_price(
        base, points, target="_target", target_id=["signal_id"], rule=FORWARD, max_age=rule.max_age_seconds, prefix="entry_"
    ))
    per_h = entered.withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    origin = F.col("entry_use_time") if rule.horizon_from == "entry" else F.col("detected_at")
    per_h = per_h.withColumn("expiry", F.when(F.col("entry_price").isNotNull(), plus_seconds(origin, F.col("horizon"))))
    final = select_price(
        per_h, points, target="expiry", target_id=["signal_id", "horizon"], rule=rule.exit_rule,
        max_age=rule.max_age_seconds, after="entry_time", prefix="final_",
    )
    move = F.when(F.col("direction") == "UP", F.col("final_price") - F.col("entry_price")).otherwise(
        F.col("entry_price") - F.col("final_price")
    )
    unresolved = "INDETERMINATE" if complete else "PENDING"
    outcome = (
        F.when(move.isNull(), unresolved).when(F.abs(move) <= rule.tie_tolerance, "TIE").when(move > 0, "WIN").otherwise("LOSS")
    )
    net = (
        F.when(F.col("outcome") == "WIN", rule.stake * rule.payout - rule.cost)
        .when(F.col("outcome") == "LOSS", -rule.stake * rule.loss - rule.cost)
        .when(F.col("outcome") == "TIE", rule.tie_net - rule.cost)
    )
    out = final.withColumn("outcome", outcome).withColumn("net", net)
    reason = F.when(move.isNotNull(), None).otherwise(F.coalesce("entry_reason", "final_reason"))
    return out.withColumns({
        "reason": reason, "cost": F.lit(rule.cost),
        "settled_at": F.coalesce("final_available", "expiry", "detected_at"),
        "break_even": break_even(F.lit(rule.stake), F.lit(rule.payout), F.lit(rule.loss), F.lit(rule.cost)),
        "simulation_id": F.concat_ws(":", "signal_id", F.col("horizon").cast("bigint").cast("string")),
    }).drop("_target")


def research_part(boundary: Column) -> Column:
    """EVALUATION, EXPLORATION, or PURGED when a result reaches across the boundary."""
    whole = (F.coalesce("expiry", "detected_at") <= boundary) & (F.coalesce("final_available", "expiry", "detected_at") <= boundary)
    return F.when(F.col("detected_at") >= boundary, "EVALUATION").when(whole, "EXPLORATION").otherwise("PURGED")


def aggregate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, nets, win rate, break-even and settlement-order drawdown per key."""
    gross = F.col("net") + F.col("cost")
    flag = lambda o: F.count_if(F.col("outcome") == o)
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0))
    resolved = flag("WIN") + flag("LOSS") + flag("TIE")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample"), *[flag(o).alias(o.lower()) for o in OUTCOMES], resolved.alias("resolved"),
        F.coalesce(F.sum("net"), F.lit(0.0)).alias("net_result"), total(gross, gross > 0).alias("gross_wins"),
        total(gross, gross < 0).alias("gross_losses"), total(F.col("net"), F.col("net") > 0).alias("net_wins"),
        total(F.col("net"), F.col("net") < 0).alias("net_losses"),
        F.try_divide(flag("WIN").cast("double"), resolved).alias("win_rate"), F.avg("break_even").alias("break_even"),
        (F.count_if(F.col("net").isNotNull() & F.col("settled_at").isNull()) == 0).alias("_ordered"),
    )
    order = ["settled_at", "simulation_id"]
    curve = equity_curve(rows.select(*keys, *order, "net"), keys, order, "net", "settled_at")
    worst = drawdown_summary(curve, keys, order, "settled_at").select(*keys, "max_drawdown")
    joined = out.join(worst, list(keys), "left")
    return joined.withColumn("max_drawdown", F.when(F.col("_ordered"), F.col("max_drawdown"))).drop("_ordered")


def segments(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``aggregate`` for the full combination, every single dimension, and the grand total.

    Each row is expanded to its groupings once; a dimension outside a grouping is "*".
    """
    groupings = [tuple(dims), *[(d,) for d in dims], ()]
    sets = [
        F.struct(F.lit("+".join(g) if g else "total").alias("grouping"), *[
            (F.coalesce(F.col(d).cast("string"), F.lit("UNKNOWN")) if d in g else F.lit("*")).alias(d) for d in dims
        ])
        for g in groupings
    ]
    wide = rows.withColumn("_g", F.explode(F.array(*sets))).drop(*dims).select("*", "_g.*").drop("_g")
    return aggregate(wide, ["grouping", *dims])


def _islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column) -> DataFrame:
    from tickloom.operators.scan import run_sum

    chunked = range_chunks(rows.withColumn("_new", starts.cast("int")), keys, order)
    return running(chunked, keys, order, {"_island": run_sum("_new")}).drop("_new", "_chunk")


def dependency_groups(
    signals: DataFrame, keys: Sequence[str], *, at: str, ident: str, window: float, block: int = 65536,
) -> DataFrame:
    """Group signals: a new group starts when a signal is more than ``window`` seconds
    after the *first* one of the current group.

    The chain of first rows is ranked in parallel. Blocks of ``block`` rows of a key find, for each of their rows, the last
    first row that a chain entering there has in the block; one ordered scan gives the row where that chain enters a later
    block; doubling these jumps marks the true entry of each block in log2(blocks) small joins; and the blocks then
    walk from their entries. No step needs a quiet time, so a hot key without one is spread like any other.
    """
    gap_us, keys = round(window * 1_000_000), list(keys)
    placed = running(range_chunks(signals.select(*keys, at, ident), keys, [at, ident]), keys, [at, ident], {"_nth": run_count(F.lit(1))})
    placed = pin(placed.select(
        *keys, ident, F.unix_micros(at).alias("_us"), (F.col("_nth") - 1).alias("_pos"), F.floor((F.col("_nth") - 1) / block).alias("_block"),
    ))
    kinds = dict(placed.dtypes)
    named = ", ".join(f"`{n}` {kinds[n]}" for n in keys)
    comma = ", " if keys else ""

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        us = rows["_us"].to_numpy()
        ahead = np.searchsorted(us, us + gap_us, side="right")
        last = np.where(ahead < len(us), ahead, np.arange(len(us)))
        while (last[last] != last).any():
            last = last[last]
        return rows[[*keys, "_pos"]].assign(_exit=us[last])

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        us, entry = rows["_us"].to_numpy(), rows["_entry"].iloc[0]
        flags = np.zeros(len(us), dtype=bool)
        here = len(us) if pd.isna(entry) else int(entry) - int(rows["_pos"].iloc[0])
        while here < len(us):
            flags[here] = True
            here = int(np.searchsorted(us, us[here] + gap_us, side="right"))
        return rows[[*keys, ident]].assign(group_start=flags)

    ends = pin(placed.groupBy(*keys, "_block").applyInPandas(exits, f"{named}{comma}_pos bigint, _exit bigint"))
    # From late to early, the last row seen before an exit's limit is the first one beyond it; of equal times the lowest place.
    none = F.lit(None).cast("bigint")
    seen = placed.select(*keys, (-F.col("_us")).alias("_back"), F.lit(1).alias("_kind"), (-F.col("_pos")).alias("_tie"), F.col("_pos").alias("_row"), none.alias("_exit"))
    asked = ends.select(*keys, "_exit").distinct().select(
        *keys, (-F.col("_exit") - gap_us).alias("_back"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"), none.alias("_row"), "_exit",
    )
    order = ["_back", "_kind", "_tie"]
    scanned = running(range_chunks(seen.unionByName(asked), keys, order), keys, order, {"_to": run_last("_row")})
    beyond = pin(scanned.where((F.col("_kind") == 0) & F.col("_to").isNotNull()).select(*keys, "_exit", "_to"))
    entries = beyond.select(*keys, F.col("_to").alias("_pos")).distinct()
    first = placed.where("_pos = 0").select(*keys, "_pos")
    jumps = pin(ends.join(entries.union(first), [*keys, "_pos"], "left_semi").join(beyond, [*keys, "_exit"]).select(*keys, "_pos", "_to"))
    marked = pin(first)
    while True:
        reached = pin(marked.join(jumps, [*keys, "_pos"]).select(*keys, F.col("_to").alias("_pos")))
        if reached.isEmpty():
            break
        marked = pin(marked.unionByName(reached))
        onward = jumps.select(*keys, F.col("_pos").alias("_to"), F.col("_to").alias("_then"))
        jumps = pin(jumps.join(onward, [*keys, "_to"]).select(*keys, "_pos", F.col("_then").alias("_to")))
    entered = marked.select(*keys, F.floor(F.col("_pos") / block).alias("_block"), F.col("_pos").alias("_entry"))
    walked = placed.join(entered, [*keys, "_block"], "left").groupBy(*keys, "_block")
    return walked.applyInPandas(starts, f"{named}{comma}`{ident}` {kinds[ident]}, group_start boolean")


def position_book(outcomes: DataFrame, keys: Sequence[str], *, max_positions: int = 1) -> DataFrame:
    """Accept results in time order while fewer than ``max_positions`` are open.

    A result that starts when every earlier one has expired finds the book empty, so the
    fold restarts there; stretches of overlapping results are folded independently with
    at most ``max_positions`` expiries in memory.
    """
    order = ["_at", "simulation_id"]
    rows = outcomes.withColumns({
        "_at": F.coalesce("entry_use_time", "detected_at"), "_entered": F.col("entry_price").isNotNull(),
    }).select(*keys, "simulation_id", "_at", "_entered", "expiry")
    busy = running(range_chunks(rows, keys, order), keys, order, {"_busy": run_max("expiry")}, inclusive=False).drop("_chunk")
    fresh = F.col("_busy").isNull() | (F.col("_at") >= F.col("_busy"))
    parts = _islands(busy, keys, order, fresh).drop("_busy")
    parts = parts.withColumns({"_us": F.unix_micros("_at"), "_exp": F.unix_micros("expiry")})
    names = [*keys, "simulation_id"]

    def step(state, batch: pd.DataFrame):
        live, taken = list(state or []), []
        for us, exp, entered in zip(batch["_us"], batch["_exp"], batch["_entered"]):
            live = [e for e in live if e > us]
            ok = not entered or len(live) < max_positions
            if ok and entered:
                live.append(exp)
            taken.append(ok)
        return live, batch[names].assign(accepted=taken)

    kinds = dict(parts.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", accepted boolean"
    marks = fold_sorted(parts.drop("_at"), [*keys, "_island"], ["_us", "simulation_id"], step, schema)
    return outcomes.join(marks, names)


def book_summary(booked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accepted, skipped, final balance and drawdown, with balances moving at expiry."""
    taken = booked.where("accepted").withColumn("_due", F.coalesce("expiry", "detected_at"))
    order = ["_due", "detected_at", "simulation_id"]
    curve = equity_curve(taken.select(*keys, *order, "net"), keys, order, "net", "_due")
    worst = drawdown_summary(curve, keys, order, "_due").select(*keys, "max_drawdown")
    counts = booked.groupBy(*keys).agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("accepted"), F.col("net"))), F.lit(0.0)).alias("balance"),
    )
    return counts.join(worst, list(keys), "left")
