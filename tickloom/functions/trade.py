"""Trade arithmetic on columns: sizing, re-pricing, profit and loss, R multiples, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import C, codes, col

# The stress scenarios (latency in seconds, slippage in pips, multipliers).
SCENARIOS = (
    ("base", 5, 0.1, 1.0, 1.0),
    ("adverse", 10, 0.2, 1.5, 1.5),
    ("extreme", 10, 0.2, 2.0, 2.0),
)


def per_scenario(df: DataFrame) -> DataFrame:
    """Every row once per scenario, by exploding a three-element literal (no join)."""
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("scenario"), F.lit(lat).alias("latency_seconds"), F.lit(slip).alias("slippage_pips"),
            F.lit(spread).alias("spread_multiplier"), F.lit(cost).alias("cost_multiplier"),
        )
        for n, lat, slip, spread, cost in SCENARIOS
    ])
    return df.withColumn("_s", F.explode(rows)).select(*df.columns, "_s.*")


def widened(bid: C, ask: C, multiplier: C) -> tuple[Column, Column]:
    """Bid and ask with the spread scaled around the unchanged mid."""
    mid = (col(bid) + col(ask)) / 2
    half = (col(ask) - col(bid)) * col(multiplier) / 2
    return mid - half, mid + half


def quantity_issue(qty: C, minimum: C, maximum: C, step: C, *, opening: bool = True) -> Column:
    """Why a quantity cannot be sent, or NULL. Limits are in protocol units (hundredths)."""
    units = col(qty) * 100
    out = F.when(col(qty).isNull() | (col(qty) <= 0), "not_positive").when(units != F.floor(units), "not_exact")
    if opening:
        out = out.when((units < col(minimum)) | (units > col(maximum)), "outside_range")
        out = out.when((units - col(minimum)) % col(step) != 0, "off_step")
    return out


@dataclass(frozen=True)
class SizingRule:
    stop_atr: float = 1.5
    target_atr: float = 3.0
    risk_fraction: float = 0.0025


def sized_entries(
    rows: DataFrame, rule: SizingRule = SizingRule(), *, price: str = "close", atr: str = "atr", equity: C = "equity",
    fixed_cost: C = "fixed_cost", variable_cost: C = "variable_cost", unit_value: C = "unit_value",
    minimum: C = "quantity_min", maximum: C = "quantity_max", step: C = "quantity_step",
) -> DataFrame:
    """Stop, target, risk budget and whole-step quantity for rows with a direction."""
    up = F.col("direction") == "UP"
    side = F.when(up, 1.0).otherwise(-1.0)
    stop_distance = F.col(atr) * rule.stop_atr
    budget = col(equity) * rule.risk_fraction
    known = col(fixed_cost).isNotNull() & col(variable_cost).isNotNull()
    per_unit = stop_distance * col(unit_value)
    raw = F.when(
        known, F.greatest(budget - col(fixed_cost), F.lit(0.0)) / (per_unit + col(variable_cost))
    ).otherwise(budget / per_unit)
    quantity = F.least(F.floor(raw / col(step)) * col(step), F.floor(col(maximum) / col(step)) * col(step))
    out = rows.withColumns({
        "stop_distance": stop_distance, "risk_budget": budget, "quantity": quantity,
        "stop": F.col(price) - side * stop_distance, "target": F.col(price) + side * F.col(atr) * rule.target_atr,
    })
    small = F.col("quantity") < col(minimum)
    reasons = codes([
        ("QUANTITY_BELOW_MIN", small), ("RISK_BUDGET_WOULD_BE_EXCEEDED", small),
        ("RISK_SIZING_UNKNOWN", F.col("quantity").isNull()),
    ])
    risk = F.col("quantity") * per_unit
    expected = F.when(known, risk + col(fixed_cost) + F.col("quantity") * col(variable_cost))
    return out.withColumns({"reasons": reasons, "planned_risk": risk, "expected_loss_at_stop": expected})


def trade_pnl(
    trades: DataFrame, *, slippage: C, commission_fixed: C, commission_per_unit: C, financing_rate: C,
    conversion: C, entry: str = "entry_reference", close: str = "close_reference",
) -> DataFrame:
    """Executed prices, gross, costs and net in account currency.

    Prices slip against the trade. Gross comes from executed prices; slippage is reported
    and never deducted again. An unknown commission, financing rate or conversion leaves
    cost and net NULL; gross survives unless its own conversion is unknown.
    """
    sign = F.when(F.col("direction") == "UP", F.lit(1)).otherwise(F.lit(-1))
    money = "decimal(30,8)"
    executed_entry = (F.col(entry) + sign * col(slippage)).cast("decimal(18,6)")
    executed_close = (F.col(close) - sign * col(slippage)).cast("decimal(18,6)")
    out = trades.withColumns({"entry_price": executed_entry, "close_price": executed_close, "_sign": sign})
    gross = ((F.col("close_price") - F.col("entry_price")) * F.col("units") * F.col("_sign")).cast(money)
    reference = ((F.col(close) - F.col(entry)) * F.col("units") * F.col("_sign")).cast(money)
    out = out.withColumns({"_gross": gross, "_ref": reference})
    slip = F.greatest(F.col("_ref") - F.col("_gross"), F.lit(0).cast(money))
    commission = (col(commission_fixed) + col(commission_per_unit) * F.col("units")).cast(money)
    seconds = (F.unix_micros("close_at") - F.unix_micros("entry_at")) / F.lit(1_000_000)
    notional = F.abs(F.col("entry_price") * F.col("units")).cast("double")
    financing = (notional * col(financing_rate).cast("double") * seconds).cast(money)
    out = out.withColumns({"slippage_cost": slip, "commission": commission, "financing": financing})
    rate = col(conversion)
    gross_account = (F.col("_gross") * rate).cast("decimal(30,6)")
    cost = ((F.col("commission") + F.col("financing")) * rate).cast("decimal(30,6)")
    reason = (
        F.when(F.col("commission").isNull(), "COMMISSION_UNKNOWN").when(F.col("financing").isNull(), "FINANCING_RATE_MISSING")
        .when(rate.isNull(), "CONVERSION_RATE_MISSING")
    )
    return out.withColumns({
        "gross": gross_account, "cost": cost, "net": (gross_account - cost).cast("decimal(30,6)"), "pnl_reason": reason,
    }).drop("_sign", "_gross", "_ref")


def r_multiple(net: C, initial_risk: C, explicit: C, cost: C) -> tuple[Column, Column]:
    """Net in units of initial risk, and its state OK / INVALID / NOT_ASSESSED."""
    r = F.try_divide(col(net).cast("double"), col(initial_risk).cast("double"))
    clash = col(explicit).isNotNull() & (F.abs(col(explicit) - r) > 1e-9 * F.greatest(F.abs(r), F.lit(1.0)))
    state = (
        F.when(col(net).isNull() | col(cost).isNull(), "NOT_ASSESSED")
        .when(col(initial_risk).isNull() | (col(initial_risk) <= 0), "INVALID")
        .when(clash, "INVALID").otherwise("OK")
    )
    return F.when(state == "OK", r), state


def filled_quantities(requested: C, hypothesis: C, fraction: C) -> dict[str, Column]:
    """Requested, filled, cancelled and rejected quantity under a fill hypothesis."""
    q, h = col(requested), col(hypothesis)
    filled = F.when(h == "FULL", q).when(h == "IOC_PARTIAL", q * col(fraction)).otherwise(q * 0)
    return {
        "requested": q, "filled": filled,
        "cancelled": F.when(h == "IOC_PARTIAL", q - filled).otherwise(q * 0),
        "rejected": F.when(h == "REJECTED", q).otherwise(q * 0),
    }


def research_year_label(t: C, warmup: int, development: int, development_end: int, walk_end: int, holdout: int, holdout_end: int) -> Column:
    """WARMUP, DEV, WF_yyyy, or the reason why the year is closed to research."""
    y = F.year(col(t))
    return (
        F.when((y < warmup) | (y > holdout_end), "OUTSIDE").when(y >= holdout, "HOLDOUT_CLOSED")
        .when(y < development, "WARMUP").when(y <= development_end, "DEV")
        .when(y <= walk_end, F.concat(F.lit("WF_"), y.cast("string"))).otherwise("UNREGISTERED")
    )


def settlement_state(raw: C) -> Column:
    """Ledger state vocabulary; anything else is UNKNOWN."""
    s = F.upper(F.trim(col(raw)))
    return (
        F.when(s.isin("CLOSED", "SETTLED"), "CLOSED").when(s.isin("OPEN", "PENDING"), "OPEN")
        .when(s.isin("REJECTED", "CANCELLED"), "REJECTED").otherwise("UNKNOWN")
    )


def timing_relation(event: C, received: C, available: C) -> Column:
    return (
        F.when(col(event).isNull(), "UNKNOWN_EVENT_TIME").when(col(available) < col(event), "AVAILABLE_BEFORE_EVENT")
        .when(col(received) < col(event), "RECEIVED_BEFORE_EVENT").otherwise("OK")
    )


def quote_relation(bid: C, ask: C) -> Column:
    return (
        F.when(col(bid).isNull() | col(ask).isNull(), "INCOMPLETE").when(col(bid) >= col(ask), "CROSSED").otherwise("ORDERED")
    )
