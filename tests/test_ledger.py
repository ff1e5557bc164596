"""Ledger figures: unknown is not zero, drawdown and recovery."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import at
from tickloom.operators import ledger as L
from tickloom.operators import outcomes as O


def _ledger(spark, nets, variant="v"):
    data = [(variant, at(86400 * i), f"t{i:03d}", None if n is None else Decimal(n)) for i, n in enumerate(nets)]
    return spark.createDataFrame(data, "variant string, close_at timestamp, trade_id string, net decimal(18,4)")


def test_unknown_is_not_zero(spark):
    r = L.net_metrics(_ledger(spark, ["5", None, "-2"]), ["variant"]).first()
    assert r["net"] is None and r["known_net"] == 3 and r["expectancy"] is None
    assert r["status"] == "PARTIAL_NOT_ASSESSED"
    assert L.net_metrics(_ledger(spark, [None]), ["variant"]).first()["status"] == "NOT_ASSESSED"


def _drawdown(spark, nets, level=False):
    order = ["close_at", "trade_id"]
    curve = L.equity_curve(_ledger(spark, nets), ["variant"], order, "net", "close_at", level=level)
    return L.drawdown_summary(curve, ["variant"], order, "close_at").first()


def test_drawdown_recovers(spark):
    r = _drawdown(spark, ["10", "-4", "-2", "7", "1"])
    assert r["max_drawdown"] == 6 and r["peak_at"] == at(0) and r["trough_at"] == at(2 * 86400)
    assert r["recovery_state"] == "RECOVERED" and r["recovery_seconds"] == 3 * 86400


def test_drawdown_open_at_the_end(spark):
    r = _drawdown(spark, ["100", "90", "95"], level=True)
    assert r["max_drawdown"] == 10 and r["recovery_state"] == "UNRECOVERED"
    assert r["unrecovered_since"] == at(0) and r["unrecovered_seconds"] == 2 * 86400


def test_equal_equity_recovers_but_keeps_the_first_peak(spark):
    r = _drawdown(spark, ["100", "90", "100", "80", "100"], level=True)
    assert r["recovery_state"] == "RECOVERED" and r["recovery_seconds"] == 4 * 86400


def test_cost_bridge_derives_the_missing_side(spark):
    rows = [("v", Decimal(10), Decimal(2), None), ("v", None, Decimal(1), Decimal(4)), ("v", Decimal(3), None, None)]
    df = spark.createDataFrame(rows, "variant string, gross decimal(18,4), cost decimal(18,4), net decimal(18,4)")
    r = L.cost_bridge(df, ["variant"]).first()
    assert (r["known_gross"], r["known_net"], r["unknown_net"], r["complete"]) == (18, 12, 1, False)
    assert r["net"] is None and r["gross"] == 18


def test_drop_best_on_one_hot_variant(spark):
    df = _ledger(spark, [str(i) for i in range(200)])
    r = L.drop_best(df, ["variant"], "net", "trade_id", 3).first()
    assert (r["total"], r["without_best"]) == (sum(range(200)), sum(range(197)))


def test_dependency_groups_are_anchored(spark):
    data = [("v", at(s), f"s{i}") for i, s in enumerate([0, 40, 80, 120, 130, 500])]
    df = spark.createDataFrame(data, "variant string, detected_at timestamp, signal_id string")
    out = O.dependency_groups(df, ["variant"], at="detected_at", ident="signal_id", window=60)
    starts = sorted(r["signal_id"] for r in out.where("group_start").collect())
    assert starts == ["s0", "s2", "s5"]


def test_position_book_skips_overlaps(spark):
    rows = [("v", f"s{i}", at(a), at(a), at(b), 1.0, 1.0) for i, (a, b) in enumerate([(0, 100), (50, 150), (100, 200), (300, 310)])]
    df = spark.createDataFrame(
        rows, "variant string, simulation_id string, detected_at timestamp, entry_use_time timestamp, expiry timestamp, entry_price double, net double"
    )
    taken = {r["simulation_id"]: r["accepted"] for r in O.position_book(df, ["variant"]).collect()}
    assert taken == {"s0": True, "s1": False, "s2": True, "s3": True}
    both = O.position_book(df, ["variant"], max_positions=2)
    assert both.where(~F.col("accepted")).count() == 0


@pytest.mark.parametrize("block, window", [(3, 10), (16, 0), (8192, 10)])
def test_dependency_groups_without_a_quiet_point(spark, block, window):
    draw = random.Random(block)
    data, n = [], 0
    for variant, size in (("dense", 900), ("b", 40), ("one", 1)):
        second = 0
        for _ in range(size):
            second += draw.choice([0, 0, 1, 2, 7])
            data.append((variant, at(second), f"{n:05}"))
            n += 1
    draw.shuffle(data)
    df = spark.createDataFrame(data, "variant string, at timestamp, ident string")
    want, anchor, current = {}, None, None
    for variant, moment, ident in sorted(data):
        new = variant != current or (moment - anchor).total_seconds() > window
        anchor, current = moment if new else anchor, variant
        want[ident] = new
    got = O.dependency_groups(df, ["variant"], at="at", ident="ident", window=window, block=block).collect()
    assert len(got) == len(data) and {r.ident: r.group_start for r in got} == want
    if block == 3:
        assert O.dependency_groups(df.limit(0), ["variant"], at="at", ident="ident", window=5).count() == 0


@pytest.mark.parametrize("name", ["a16_concentration", "a26_deflated_sharpe", "a36_window_statistics", "j10_open_quantity"])
def test_the_ledger_is_joined_once_a_query(spark, small, name):
    """What a query reads again is written down once; its plan joins lines and orders no second time."""
    from tickloom.plans import all_queries

    plan = all_queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan


def test_ledger_amounts_are_made_before_the_join(spark, small):
    from tickloom.plans import inputs

    plan = inputs.ledger(spark, small).select("net")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert plan.children().head().output().size() == 2
