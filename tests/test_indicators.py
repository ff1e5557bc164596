"""Indicator windows against known values and a plain recursion."""

import random

import pytest

from helpers import bars
from tickloom.operators.indicators import Periods, add_indicators, warmup_segments


def _recursion(closes, n, decay):
    out, total, value = [], 0.0, None
    for i, x in enumerate(closes, 1):
        if i <= n:
            total += x
            value = total / n if i == n else None
        else:
            value = decay * value + (1 - decay) * x
        out.append(value)
    return out


def _points(df, periods):
    return add_indicators(df, periods).orderBy("start").collect()


def test_known_values(spark):
    pts = _points(bars(spark, [1, 2, 3, 2, 2]), Periods(3, 3, 3, 3))
    assert [p["ema_fast"] for p in pts] == [None, None, 2.0, 2.0, 2.0]
    assert pts[3]["rsi"] == pytest.approx(66.6666667)
    spread = [(2, 3, 1, 2), (2, 3, 1, 2), (2, 3, 1, 2)]
    assert _points(bars(spark, spread), Periods(3, 3, 3, 3))[2]["atr"] == 2.0


def test_long_series_crosses_blocks(spark):
    rng = random.Random(1)
    closes = [100 + rng.uniform(-5, 5) for _ in range(900)]
    pts = _points(bars(spark, closes), Periods(20, 200, 14, 14))
    for name, n in (("ema_fast", 20), ("ema_slow", 200)):
        want = _recursion(closes, n, 1 - 2 / (n + 1))
        assert [p[name] is None for p in pts] == [w is None for w in want]
        assert [p[name] for p in pts if p[name] is not None] == pytest.approx([w for w in want if w is not None], rel=1e-9)


def test_long_period_over_a_long_series(spark):
    rng = random.Random(2)
    closes = [100 + rng.uniform(-5, 5) for _ in range(100_000)]
    pts = _points(bars(spark, closes), Periods(20, 5000, 5000, 14))
    want = _recursion(closes, 5000, 1 - 2 / 5001)
    assert [p["ema_slow"] for p in pts[4999::997]] == pytest.approx(want[4999::997], rel=1e-9)
    gains = _recursion([max(b - a, 0) for a, b in zip(closes, closes[1:])], 5000, 4999 / 5000)
    losses = _recursion([max(a - b, 0) for a, b in zip(closes, closes[1:])], 5000, 4999 / 5000)
    assert [p["rsi"] for p in pts[5000::997]] == pytest.approx([100 - 100 / (1 + g / lo) for g, lo in zip(gains[4999::997], losses[4999::997])], rel=1e-8)


def test_flat_stretch_keeps_the_old_ratio(spark):
    closes = [1, 3, 2, 5, 4, 6] + [6] * 700
    last = _points(bars(spark, closes), Periods(3, 3, 3, 3))[-1]["rsi"]
    gains = [max(b - a, 0) for a, b in zip(closes, closes[1:])]
    losses = [max(a - b, 0) for a, b in zip(closes, closes[1:])]
    g, lo = _recursion(gains, 3, 2 / 3)[-1], _recursion(losses, 3, 2 / 3)[-1]
    assert last == pytest.approx(100 - 100 / (1 + g / lo))


def test_gap_restarts_warmup(spark):
    df = bars(spark, list(range(12)), skip=(5,))
    pts = _points(df, Periods(3, 3, 3, 3))
    values = {int(p["close"]): p["ema_fast"] for p in pts}
    # bar 6 only marks the restart; bars 7..9 are samples 1..3
    assert values[4] is not None and values[6] is None and values[8] is None and values[9] == 8.0


def test_open_bar_forgets_the_end_before_it(spark):
    first, odd = bars(spark, [1, 2]), bars(spark, [9], start=120, closed=False)
    later = bars(spark, [3, 4], start=300)
    got = [(r["close"], r["eligible"]) for r in warmup_segments(first.unionByName(odd).unionByName(later)).orderBy("start").collect()]
    assert got == [(1.0, True), (2.0, True), (9.0, False), (3.0, True), (4.0, True)]


def test_prefix_gives_the_same_values(spark):
    closes = [10 + (i * 7) % 5 for i in range(60)]
    whole = _points(bars(spark, closes), Periods(5, 9, 5, 5))[:30]
    prefix = _points(bars(spark, closes[:30]), Periods(5, 9, 5, 5))
    assert [(p["ema_slow"], p["rsi"]) for p in whole] == [(p["ema_slow"], p["rsi"]) for p in prefix]
