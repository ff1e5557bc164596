"""As-of selection, interval extremes and first touch against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import EPOCH, at
from tickloom.operators import intervals as V
from tickloom.operators.asof import BACKWARD, FORWARD, latest_known, select_price
from tickloom.operators.exits import first_touch


def _quotes(rng, n=300):
    out = []
    for i in range(n):
        t = rng.uniform(0, 20000)
        out.append(("X" if rng.random() < 0.8 else "Y", at(t), at(t + rng.choice([0, 0, 5, 900])), i, 100 + rng.uniform(-3, 3)))
    return out


SCHEMA = "instrument string, event_time timestamp, available_at timestamp, seq bigint, bid double"


def test_latest_known_ignores_rows_not_yet_available(spark):
    rng = random.Random(5)
    quotes = _quotes(rng)
    marks = [("X" if rng.random() < 0.8 else "Y", at(rng.uniform(0, 20000)), i) for i in range(90)]
    marks += [("X", None, 90), ("Y", None, 91)]  # an unknown instant sees nothing, but the row stays
    left = spark.createDataFrame(marks, "instrument string, available_at timestamp, n int")
    out = latest_known(left, spark.createDataFrame(quotes, SCHEMA), left_id=["n"], right_id=["seq"], values=["seq"])
    got = {r["n"]: r["q_seq"] for r in out.collect()}
    assert len(got) == len(marks)
    for k, t, n in marks:
        seen = [q for q in quotes if t is not None and q[0] == k and q[1] <= t and q[2] <= t]
        assert got[n] == (max(seen, key=lambda q: (q[1], q[2], q[3]))[3] if seen else None)


@pytest.mark.parametrize("rule", [FORWARD, BACKWARD])
def test_price_selection_policy(spark, rule):
    rng = random.Random(8)
    quotes = _quotes(rng, 120)
    pts = spark.createDataFrame(quotes, SCHEMA).select(
        "instrument", "event_time", "available_at", F.col("bid").alias("price"), F.col("seq").alias("ordinal"), F.col("seq").cast("string").alias("point_id")
    )
    wanted = [("X", at(rng.uniform(0, 20000)), at(rng.uniform(-500, 20000)), i) for i in range(60)]
    df = spark.createDataFrame(wanted, "instrument string, goal timestamp, after timestamp, n int")
    out = select_price(df, pts, target="goal", target_id=["n"], rule=rule, max_age=200, after="after")
    for r in out.collect():
        k, goal, after, _ = wanted[r["n"]]
        ok = [q for q in quotes if q[0] == k and q[1] > after]
        if rule == FORWARD:
            ok = sorted((q for q in ok if q[1] >= goal), key=lambda q: (q[1], q[2], q[3]))
        else:
            ok = sorted((q for q in ok if q[1] <= goal and (q[2] - goal).total_seconds() <= 200), key=lambda q: (q[1], q[2], q[3]), reverse=True)
        if not ok:
            assert r["reason"] == "PRICE_NOT_AVAILABLE" and r["price"] is None
            continue
        age = max(abs((ok[0][1] - goal).total_seconds()), (ok[0][2] - goal).total_seconds(), 0)
        assert r["reason"] == ("MAX_PRICE_AGE_EXCEEDED" if age > 200 else None)
        assert r["point_id"] == (None if age > 200 else str(ok[0][3]))


def _market(rng, n=400):
    t = 0.0
    out = []
    for i in range(n):
        t += rng.choice([0.0, 0.000001, 0.3, 40, 900])
        bid = 100 + rng.uniform(-5, 5)
        out.append(("X", at(t), i, bid, bid + rng.uniform(0.1, 1)))
    return out


@pytest.fixture(params=[(256, 64), (4, 2), (1, 3)])
def index_shape(request, monkeypatch):
    """Trees of several heights."""
    monkeypatch.setattr(V, "BLOCK", request.param[0])
    monkeypatch.setattr(V, "FAN", request.param[1])


def test_extremes_over_intervals(spark, index_shape):
    rng = random.Random(2)
    quotes = _market(rng)
    spans = []
    for i in range(50):
        a = quotes[rng.randrange(len(quotes))][1]
        spans.append(("X", i, a, at((a - EPOCH).total_seconds() + rng.choice([0, 0.000002, 1, 3000, 90000]))))
    q = spark.createDataFrame(quotes, "instrument string, event_time timestamp, seq int, bid double, ask double")
    s = spark.createDataFrame(spans, "instrument string, n int, a timestamp, b timestamp")
    got = {r["n"]: r for r in V.extremes(s, q, ["n"], start="a", end="b").collect()}
    for _, n, a, b in spans:
        inside = [x for x in quotes if a <= x[1] <= b]
        r = got[n]
        assert (r["bid_max"], r["bid_min"]) == (max(x[3] for x in inside), min(x[3] for x in inside))
        assert (r["ask_max"], r["ask_min"]) == (max(x[4] for x in inside), min(x[4] for x in inside))


def test_first_touch_matches_a_walk(spark, index_shape):
    rng = random.Random(4)
    quotes = _market(rng)
    trades = []
    for i in range(40):
        a = quotes[rng.randrange(len(quotes))][1]
        b = at((a - EPOCH).total_seconds() + rng.choice([1, 2000, 50000]))
        side = rng.choice(["UP", "DOWN"])
        sign = 1 if side == "UP" else -1
        trades.append(("X", f"t{i}", side, a, b, 100 - sign * rng.uniform(0, 5), 100 + sign * rng.uniform(0, 5)))
    q = spark.createDataFrame(quotes, "instrument string, event_time timestamp, seq int, bid double, ask double")
    t = spark.createDataFrame(trades, "instrument string, trade_id string, direction string, entry_at timestamp, close_at timestamp, stop double, target double")
    got = {r["trade_id"]: (r["exit"], r["exit_at"]) for r in first_touch(t, q, "trade_id").collect()}
    for _, tid, side, a, b, stop, target in trades:
        want = ("TIME", b)
        for when in sorted({x[1] for x in quotes if a <= x[1] <= b}):
            here = [x[3] if side == "UP" else x[4] for x in quotes if x[1] == when]
            stopped = any(p <= stop if side == "UP" else p >= stop for p in here)
            hit = any(p >= target if side == "UP" else p <= target for p in here)
            if stopped or hit:
                want = ("STOP" if stopped else "TARGET", when)
                break
        assert got[tid] == want


@pytest.mark.parametrize("rule", [FORWARD, BACKWARD])
def test_stretches_without_a_target_send_only_rows_that_can_be_chosen(spark, rule):
    import random
    from datetime import datetime, timedelta

    from tickloom.operators import asof

    rng, base = random.Random(5), datetime(2024, 1, 1)
    times = [base + timedelta(seconds=rng.choice([0, 1, 400, 899, 900, 901]) + 900 * rng.randrange(200)) for _ in range(3000)]
    pts = [("A", t, t + timedelta(seconds=rng.choice([0, 5, 2000])), rng.random(), i, f"p{i}") for i, t in enumerate(times)]
    goals = [("A", n, base + timedelta(seconds=rng.randrange(-900, 900 * 201))) for n in range(12)]
    p = spark.createDataFrame(pts, "instrument string, event_time timestamp, available_at timestamp, price double, ordinal long, point_id string")
    g = spark.createDataFrame(goals, "instrument string, n long, goal timestamp")
    got = {r.n: r.point_id for r in select_price(g, p, target="goal", target_id=["n"], rule=rule, max_age=1e6).collect()}
    late = timedelta(seconds=1e6)
    for _, n, goal in goals:
        fit = [x for x in pts if (x[1] >= goal if rule == FORWARD else x[1] <= goal and x[2] <= goal + late)]
        best = (min if rule == FORWARD else max)(fit, key=lambda x: (x[1], x[2], x[4]), default=None)
        assert got[n] == (best and best[5])
    side = lambda df, at: df.select("instrument", F.unix_micros(at).alias("_t"), F.struct(at).alias("_hit"))
    kept = asof._can_win(side(p, "event_time"), side(g, "goal"), ["instrument"], "event_time", newest=rule == BACKWARD).count()
    assert kept < 1200


def test_events_of_one_instant_are_one_row(spark):
    from tickloom.operators.intervals import level_at, signed_events

    rows = [("A", f"2024-01-{1 + i % 3:02} 00:00:00", f"2024-01-{5 + i % 2:02} 00:00:00", 2.0) for i in range(60)]
    t = spark.createDataFrame(rows, "k string, a string, b string, u double").withColumns({"a": F.to_timestamp("a"), "b": F.to_timestamp("b")})
    assert signed_events(t, {"u": F.col("u")}, key=["k"], entry="a", close="b").count() == 5
    marks = t.select("k", F.col("b").alias("at")).distinct().unionByName(t.select("k", F.col("a").alias("at")).distinct())
    out = level_at(t, marks, {"u": F.col("u")}, key=["k"], entry="a", close="b", mark_at="at", mark_id="at")
    assert [r.open_u for r in out.orderBy("at").collect()] == [40.0, 80.0, 120.0, 60.0, 0.0]
