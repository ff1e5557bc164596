"""Queries over the trade ledger and its statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import trade
from tickloom.functions.columns import break_even
from tickloom.operators import ledger as L
from tickloom.operators import research_windows as RW
from tickloom.operators.intervals import level_at
from tickloom.plans import inputs as I
from tickloom.plans.indicator_queries import POINTS, points
from tickloom.plans.inputs import SQL, sql_strict_bars, with_ctes
from tickloom.plans.registry import query, rnd, text_list
from tickloom.session import pin

LED = SQL["ledger"]
CLOSED = "closed AS (SELECT * FROM ledger WHERE state = 'CLOSED')"


@query(
    "a7_summary_with_unknowns",
    with_ctes(
        LED,
        select="""SELECT variant, count(net) AS known, count(*) - count(net) AS unknown, min(net)::DOUBLE AS min, max(net)::DOUBLE AS max,
            round(avg(net::DOUBLE), 4) AS mean, round(quantile_cont(net::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(net::DOUBLE, 0.95), 6) AS p95 FROM ledger GROUP BY 1""",
    ),
)
def a7_summary_with_unknowns(spark, sf):
    led = I.ledger(spark, sf).select("variant", F.col("net").cast("double").alias("net"))
    out = L.summary_with_quantiles(led, ["variant"], "net")
    return out.select("variant", "known", "unknown", "min", "max", rnd("mean", 4), rnd("p50"), rnd("p95"))


DAILY = """days AS (SELECT variant, entry_at::DATE AS day FROM closed UNION SELECT variant, close_at::DATE FROM closed),
  per AS (SELECT variant, close_at::DATE AS day, count(*) AS trades, count(*) - count(net) AS unknown, sum(net) AS known_net FROM closed GROUP BY 1, 2),
  daily AS (SELECT d.variant, d.day, coalesce(trades, 0) AS trades, coalesce(unknown, 0) AS unknown, coalesce(known_net, 0)::DECIMAL(28,4) AS known_net,
    CASE WHEN coalesce(unknown, 0) = 0 THEN coalesce(known_net, 0)::DECIMAL(28,4) END AS net FROM days d LEFT JOIN per USING (variant, day))"""


def closed_amounts(spark, sf):
    """What the daily figures need of the closed trades; written once, since trades and days read it."""
    return pin(I.closed_trades(spark, sf).select("variant", "entry_at", "close_at", "net"))


def daily(spark, sf, led=None):
    led = closed_amounts(spark, sf) if led is None else led
    stamps = led.withColumn("day", F.explode(F.array(F.to_date("entry_at"), F.to_date("close_at"))))
    return L.daily_net(led, stamps, ["variant"])


@query(
    "a12_daily_net",
    with_ctes(LED, CLOSED, DAILY, select="""SELECT variant, day::TIMESTAMP AS day, trades, unknown, known_net::DOUBLE AS known_net, net::DOUBLE AS net FROM daily"""),
)
def a12_daily_net(spark, sf):
    return daily(spark, sf).withColumn("day", F.col("day").cast("timestamp"))


@query(
    "a13_net_metrics",
    with_ctes(
        LED, CLOSED,
        select="""SELECT variant, session, count(*) AS trades, count(net) AS known, count(*) - count(net) AS unknown,
            CASE WHEN count(*) = count(net) THEN sum(net)::DOUBLE END AS net, sum(net)::DOUBLE AS known_net,
            CASE WHEN count(*) = count(net) THEN round(sum(net)::DOUBLE / count(net), 6) END AS expectancy, round(sum(net)::DOUBLE / count(net), 6) AS known_expectancy,
            CASE WHEN count(net) = 0 THEN 'NOT_ASSESSED' WHEN count(*) = count(net) THEN 'ASSESSED' ELSE 'PARTIAL_NOT_ASSESSED' END AS status FROM closed GROUP BY 1, 2""",
    ),
)
def a13_net_metrics(spark, sf):
    out = L.net_metrics(I.closed_trades(spark, sf), ["variant", "session"])
    return out.withColumns({"expectancy": F.round("expectancy", 6), "known_expectancy": F.round("known_expectancy", 6)})


@query(
    "a14_cost_bridge",
    with_ctes(
        LED, CLOSED,
        """s AS (SELECT variant, CASE WHEN part_id % 7 = 0 THEN NULL ELSE gross END AS gross, cost, net, (notional * tax_rate * 0.1::DECIMAL(2,1))::DECIMAL(18,4) AS commission FROM closed),
           d AS (SELECT variant, coalesce(gross, net + cost) AS g, coalesce(cost, gross - net) AS c, coalesce(net, gross - cost) AS n, commission FROM s)""",
        select="""SELECT variant, count(*) AS closed, CASE WHEN count(*) = count(g) THEN sum(g)::DOUBLE END AS gross, sum(g)::DOUBLE AS known_gross, count(*) - count(g) AS unknown_gross,
            CASE WHEN count(*) = count(c) THEN sum(c)::DOUBLE END AS cost, sum(c)::DOUBLE AS known_cost, count(*) - count(c) AS unknown_cost,
            CASE WHEN count(*) = count(n) THEN sum(n)::DOUBLE END AS net, sum(n)::DOUBLE AS known_net, count(*) - count(n) AS unknown_net,
            sum(commission)::DOUBLE AS total_commission, sum(c - commission)::DOUBLE AS known_other, bool_and(g IS NOT NULL AND c IS NOT NULL AND n IS NOT NULL) AS complete FROM d GROUP BY 1""",
    ),
)
def a14_cost_bridge(spark, sf):
    led = I.closed_trades(spark, sf).withColumns({
        "gross": F.when(F.col("part_id") % 7 != 0, F.col("gross")),
        "commission": (F.col("notional") * F.col("tax_rate") * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(18,4)"),
    })
    return L.cost_bridge(led, ["variant"], ["commission"])


@query(
    "a15_break_even",
    with_ctes(
        LED, CLOSED,
        select="""SELECT variant, round((sum(notional)::DOUBLE * 0.5 + sum(cost)::DOUBLE) / (sum(notional)::DOUBLE * (0.8 + 0.5)), 6) AS probability,
            round(sum(gross)::DOUBLE / count(*), 6) AS fee_per_trade FROM closed GROUP BY 1""",
    ),
)
def a15_break_even(spark, sf):
    sums = I.closed_trades(spark, sf).groupBy("variant").agg(
        F.sum("notional").cast("double").alias("stake"), F.sum("cost").cast("double").alias("c"),
        F.sum("gross").cast("double").alias("g"), F.count(F.lit(1)).alias("n"),
    )
    p = break_even("stake", F.lit(0.8), F.lit(0.5), "c")
    return sums.select("variant", F.round(p, 6).alias("probability"), F.round(F.try_divide("g", "n"), 6).alias("fee_per_trade"))


@query(
    "a16_concentration",
    with_ctes(
        LED, CLOSED, DAILY,
        select="""SELECT 'trade' AS unit, variant, count(net) AS parts, round(sum(net::DOUBLE * net::DOUBLE) / (sum(abs(net::DOUBLE)) * sum(abs(net::DOUBLE))), 9) AS hhi FROM closed GROUP BY 2
            UNION ALL SELECT 'day', variant, count(*), round(sum(known_net::DOUBLE * known_net::DOUBLE) / (sum(abs(known_net::DOUBLE)) * sum(abs(known_net::DOUBLE))), 9) FROM daily GROUP BY 2""",
    ),
)
def a16_concentration(spark, sf):
    led = closed_amounts(spark, sf)
    per_trade = L.concentration(led, ["variant"], "net").withColumn("unit", F.lit("trade"))
    per_day = L.concentration(daily(spark, sf, led), ["variant"], "known_net").withColumn("unit", F.lit("day"))
    return per_trade.unionByName(per_day).select("unit", "variant", "parts", rnd("hhi", 9))


@query(
    "a17_worst_day",
    with_ctes(LED, CLOSED, DAILY, select="""SELECT variant, arg_min(day, (known_net, day))::TIMESTAMP AS worst_day, min(known_net)::DOUBLE AS worst_net FROM daily GROUP BY 1"""),
)
def a17_worst_day(spark, sf):
    return L.worst_day(daily(spark, sf), ["variant"]).withColumn("worst_day", F.col("worst_day").cast("timestamp"))


@query(
    "a18_turnover",
    with_ctes(
        LED, CLOSED,
        """p AS (SELECT variant, units, (notional / 100)::DECIMAL(18,4) AS entry_price, CASE WHEN part_id % 9 <> 0 THEN ((notional + 5) / 100)::DECIMAL(18,4) END AS close_price, regime AS currency FROM closed),
           s AS (SELECT variant, currency, unnest([abs(entry_price * units), abs(close_price * units)]) AS v FROM p)""",
        select="""SELECT variant, round(sum(v)::DOUBLE, 4) AS known_turnover, CASE WHEN count(v) = count(*) THEN sum(v)::DOUBLE END AS turnover, count(v) AS executions,
            count(*) - count(v) AS unknown, min(currency) = max(currency) AS single_currency FROM s GROUP BY 1""",
    ),
)
def a18_turnover(spark, sf):
    led = I.closed_trades(spark, sf).withColumns({
        "entry_price": (F.col("notional") / 100).cast("decimal(18,4)"),
        "close_price": F.when(F.col("part_id") % 9 != 0, ((F.col("notional") + 5) / 100).cast("decimal(18,4)")),
    })
    out = L.turnover(led, ["variant"], entry="entry_price", close="close_price", units="units", currency="regime")
    return out.withColumn("known_turnover", F.round(F.col("known_turnover").cast("double"), 4))


MARKS = """marks AS (SELECT variant, close_at AS t, row_number() OVER (PARTITION BY variant ORDER BY close_at) AS ordinal, exposure FROM (
    SELECT variant, close_at, sum(notional) AS exposure FROM closed GROUP BY 1, 2))"""


@query(
    "a19_exposure_summary",
    with_ctes(
        LED, CLOSED, MARKS,
        "n AS (SELECT *, lead(t) OVER (PARTITION BY variant ORDER BY t) AS nx FROM marks)",
        select="""SELECT variant, max(exposure)::DOUBLE AS peak, arg_max(t, (exposure, -epoch_us(t))) AS peak_at,
            sum(CASE WHEN nx IS NOT NULL THEN (epoch_us(nx) - epoch_us(t)) / 1e6 END) AS exposed_seconds,
            round(sum((epoch_us(nx) - epoch_us(t)) / 1e6 * exposure::DOUBLE), 2) AS exposure_seconds FROM n GROUP BY 1""",
    ),
)
def a19_exposure_summary(spark, sf):
    marks = I.closed_trades(spark, sf).groupBy("variant", F.col("close_at").alias("at")).agg(
        F.sum("notional").cast("double").alias("exposure")
    ).withColumn("ordinal", F.unix_micros("at"))
    return L.exposure_summary(marks, ["variant"], at="at", ordinal="ordinal", exposure="exposure").withColumn(
        "exposure_seconds", F.round("exposure_seconds", 2)
    )


@query(
    "a20_margin_level",
    """SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 5 = 0 THEN 1.5::DOUBLE END, c_acctbal / nullif(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_nationkey * 100.0 END, 0)), 6) AS level FROM customer""",
)
def a20_margin_level(spark, sf):
    c = I.table(spark, sf, "customer").withColumns({
        "explicit": F.when(F.col("c_custkey") % 5 == 0, 1.5),
        "used": F.when(F.col("c_custkey") % 7 == 0, 0.0).otherwise(F.col("c_nationkey") * 100.0),
    })
    return c.select("c_custkey", F.round(L.margin_level("explicit", "c_acctbal", "used"), 6).alias("level"))


@query(
    "a21_funnel_counts",
    """WITH r AS (SELECT o_orderpriority AS variant, l_linestatus AS stage, l_orderkey AS evaluation_id, l_linenumber AS signal_id, l_quantity AS declared FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
       o AS (SELECT variant, stage, evaluation_id, signal_id, count(*) AS raw, max(declared) AS declared FROM r GROUP BY ALL)
       SELECT variant, stage, count(*) AS "unique", sum(raw)::BIGINT AS raw, (sum(raw) - count(*))::BIGINT AS duplicates, sum(declared) AS declared FROM o GROUP BY 1, 2""",
)
def a21_funnel_counts(spark, sf):
    li, o = I.table(spark, sf, "lineitem"), I.table(spark, sf, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("variant"), F.col("l_linestatus").alias("stage"), F.col("l_orderkey").alias("evaluation_id"),
        F.col("l_linenumber").alias("signal_id"), F.col("l_quantity").alias("declared"),
    )
    return L.funnel(rows, ["variant", "stage"], ["evaluation_id", "signal_id"], "declared")


@query(
    "a22_regime_session_table",
    with_ctes(
        LED, CLOSED,
        select="""SELECT CASE WHEN regime = 'N' THEN 'UNKNOWN' ELSE regime END AS regime_label, session AS session_label, count(*) AS trades, count(net) AS known, count(*) - count(net) AS unknown,
            CASE WHEN count(*) = count(net) THEN sum(net)::DOUBLE END AS net, round(sum(net)::DOUBLE / count(net), 6) AS known_expectancy FROM closed GROUP BY 1, 2""",
    ),
)
def a22_regime_session_table(spark, sf):
    led = I.closed_trades(spark, sf).withColumn("regime", F.when(F.col("regime") != "N", F.col("regime")))
    out = L.regime_session_table(led)
    return out.select("regime_label", "session_label", "trades", "known", "unknown", "net", rnd("known_expectancy"))


@query(
    "a23_grouped_net_and_episodes",
    with_ctes(
        LED, CLOSED,
        """ep AS (SELECT variant, episode_id FROM closed UNION SELECT o_orderpriority, 'o' || o_orderkey FROM orders)""",
        select="""SELECT c.variant, CASE WHEN count(*) = count(net) THEN sum(net)::DOUBLE END AS net, sum(net)::DOUBLE AS known_net, any_value(e.n) AS episodes FROM closed c
            JOIN (SELECT variant, count(DISTINCT episode_id) AS n FROM ep GROUP BY 1) e USING (variant) GROUP BY 1""",
    ),
)
def a23_grouped_net_and_episodes(spark, sf):
    led, o = I.closed_trades(spark, sf), I.table(spark, sf, "orders")
    known = led.select("variant", "episode_id").unionByName(
        o.select(F.col("o_orderpriority").alias("variant"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("episode_id"))
    )
    episodes = known.groupBy("variant").agg(F.count_distinct("episode_id").alias("episodes"))
    return L.net_metrics(led, ["variant"]).select("variant", "net", "known_net").join(episodes, "variant")


@query(
    "a24_mean_interval",
    with_ctes(
        LED, CLOSED,
        select="""SELECT instrument, count(net) AS n, round(avg(net::DOUBLE), 4) AS mean, round(avg(net::DOUBLE) - 1.96 * stddev_samp(net::DOUBLE) / sqrt(count(net)), 4) AS lower,
            round(avg(net::DOUBLE) + 1.96 * stddev_samp(net::DOUBLE) / sqrt(count(net)), 4) AS upper FROM closed GROUP BY 1""",
    ),
)
def a24_mean_interval(spark, sf):
    out = L.mean_interval(I.closed_trades(spark, sf), ["instrument"], "net")
    return out.select("instrument", "n", rnd("mean", 4), rnd("lower", 4), rnd("upper", 4))


@query(
    "a33_coverage_and_lifecycle",
    with_ctes(
        SQL["ticks"], sql_strict_bars(3600), sql_strict_bars(14400, "b4"), LED,
        "allb AS (SELECT tf_seconds, start, \"end\", closed FROM bars UNION ALL SELECT tf_seconds, start, \"end\", closed FROM b4)",
        select="""SELECT 'tf:' || tf_seconds AS item, min(start) AS first, max("end") AS last, count(*) FILTER (NOT closed) AS open, count(*) AS total FROM allb GROUP BY 1
            UNION ALL SELECT 'trades', min(entry_at), max(close_at), count(*) FILTER (state = 'OPEN'), count(*) FROM ledger""",
    ),
)
def a33_coverage_and_lifecycle(spark, sf):
    bars = I.strict_bars(spark, sf).unionByName(I.strict_bars(spark, sf, 14400))
    by_tf = bars.groupBy(F.concat(F.lit("tf:"), F.col("tf_seconds").cast("string")).alias("item")).agg(
        F.min("start").alias("first"), F.max("end").alias("last"), F.count_if(~F.col("closed")).alias("open"), F.count(F.lit(1)).alias("total")
    )
    trades = I.ledger(spark, sf).agg(
        F.min("entry_at").alias("first"), F.max("close_at").alias("last"), F.count_if(F.col("state") == "OPEN").alias("open"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("item", F.lit("trades"))
    return by_tf.unionByName(trades)


@query(
    "a35_drop_best",
    with_ctes(
        LED, CLOSED,
        "r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY net DESC, trade_id) AS k FROM closed WHERE net IS NOT NULL)",
        select="SELECT variant, sum(net)::DOUBLE AS total, sum(CASE WHEN k > 5 THEN net END)::DOUBLE AS without_best FROM r GROUP BY 1",
    ),
)
def a35_drop_best(spark, sf):
    return L.drop_best(I.closed_trades(spark, sf), ["variant"], "net", "trade_id", 5)


WINDOWS = """b AS (SELECT epoch_us(min(entry_at)) AS lo, epoch_us(max(entry_at)) - epoch_us(min(entry_at)) AS sp FROM ledger),
   w AS (SELECT 'walkforward_' || (i + 1) AS win, 'walkforward' AS kind, lo + round(sp * (0.4::DOUBLE + i * 0.1::DOUBLE))::BIGINT AS ts, lo + round(sp * (0.4::DOUBLE + i * 0.1::DOUBLE + 0.1::DOUBLE))::BIGINT AS te FROM b, range(4) r(i)
     UNION ALL SELECT 'holdout', 'holdout', lo + round(sp * (1.0::DOUBLE - 0.2::DOUBLE))::BIGINT, lo + sp FROM b)"""


@query(
    "a36_window_statistics",
    with_ctes(
        LED, WINDOWS,
        """a AS (SELECT win, net, epoch_us(entry_at) AS e, epoch_us(close_at) AS c, ts, te, epoch_us(entry_at) > te AND epoch_us(entry_at) <= te + 432000000000 AS emb FROM ledger, w),
           f AS (SELECT *, NOT emb AND e >= ts AND c <= te AND net IS NOT NULL AS oos FROM a)""",
        select="""SELECT win AS "window", count(*) FILTER (oos) AS oos_trades, count(*) FILTER (NOT emb AND NOT (e >= ts AND c <= te) AND e <= te AND c >= ts) AS purged_trades,
            count(*) FILTER (emb) AS embargoed_trades, sum(CASE WHEN oos THEN net END)::DOUBLE AS oos_net, round(avg(CASE WHEN oos THEN net::DOUBLE END), 4) AS oos_mean,
            round(quantile_cont(CASE WHEN oos THEN net::DOUBLE END, 0.5), 6) AS median FROM f GROUP BY 1""",
    ),
)
def a36_window_statistics(spark, sf):
    led = pin(I.ledger(spark, sf).select("entry_at", "close_at", "net"))
    wins = RW.windows_for(led, "entry_at", embargo_seconds=5 * 86400)
    out = RW.window_statistics(RW.assign_windows(led, wins))
    return out.select("window", "oos_trades", "purged_trades", "embargoed_trades", "oos_net", rnd("oos_mean", 4), rnd("median"))


@query(
    "x6_research_windows",
    with_ctes(
        LED, WINDOWS,
        select="""SELECT win AS "window", count(*) FILTER (epoch_us(entry_at) <= ts) AS train_records, count(*) FILTER (epoch_us(entry_at) > ts AND epoch_us(entry_at) <= te) AS test_records,
            count(*) FILTER (epoch_us(entry_at) > te AND epoch_us(entry_at) <= te + 432000000000) AS embargo_records FROM ledger, w GROUP BY 1""",
    ),
)
def x6_research_windows(spark, sf):
    led = I.ledger(spark, sf)
    wins = RW.windows_for(led, "entry_at", embargo_seconds=5 * 86400)
    return RW.record_counts(led, "entry_at", wins).select("window", "train_records", "test_records", "embargo_records")


@query(
    "x7_calendar_phase",
    """SELECT CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'OUTSIDE' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'WARMUP_ONLY' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'WF_EVALUATION'
         WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'HOLDOUT_REJECTED' ELSE 'OUTSIDE' END AS phase, count(*) AS rows FROM orders GROUP BY 1""",
)
def x7_calendar_phase(spark, sf):
    o = I.table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    phase = RW.calendar_phase(F.col("at"), "1995-06-01", "1998-01-01", "1999-01-01", "2001-01-01")
    return o.groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a38_net_r",
    with_ctes(
        LED, CLOSED,
        """k AS (SELECT trade_id, net, cost, CASE WHEN part_id % 13 = 0 THEN 0 ELSE notional / 20 END::DECIMAL(18,4) AS risk, CASE WHEN part_id % 17 = 0 THEN 99.0::DOUBLE END AS explicit FROM closed),
           s AS (SELECT *, CASE WHEN net IS NULL OR cost IS NULL THEN 'NOT_ASSESSED' WHEN risk <= 0 THEN 'INVALID' WHEN explicit IS NOT NULL AND abs(explicit - net::DOUBLE / risk::DOUBLE) > 1e-6 THEN 'INVALID' ELSE 'OK' END AS state FROM k)""",
        select="SELECT trade_id, state, CASE WHEN state = 'OK' THEN round(net::DOUBLE / risk::DOUBLE, 6) END AS net_r FROM s",
    ),
)
def a38_net_r(spark, sf):
    led = I.closed_trades(spark, sf).withColumns({
        "risk": F.when(F.col("part_id") % 13 == 0, F.lit(0)).otherwise(F.col("notional") / 20).cast("decimal(18,4)"),
        "explicit": F.when(F.col("part_id") % 17 == 0, 99.0),
    })
    r, state = trade.r_multiple("net", "risk", "explicit", "cost")
    return led.select("trade_id", state.alias("state"), F.round(r, 6).alias("net_r"))


@query(
    "a41_cost_state",
    with_ctes(
        LED,
        """r AS (SELECT *, CASE WHEN state = 'OPEN' THEN 'OPEN_NOT_SETTLED' WHEN cost IS NULL THEN 'CLOSED_COST_UNKNOWN' END AS reason FROM ledger)""",
        select="""SELECT variant, sum(cost)::DOUBLE AS known_cost, sum(gross)::DOUBLE AS known_gross, count(reason) AS unknown, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY 1""",
    ),
)
def a41_cost_state(spark, sf):
    return L.cost_state(I.ledger(spark, sf), ["variant"], ["cost", "gross"])


EQ = """eq AS (SELECT variant, close_at, trade_id, sum(net) OVER w AS equity FROM closed WHERE net IS NOT NULL WINDOW w AS (PARTITION BY variant ORDER BY close_at, trade_id)),
  pk AS (SELECT *, max(equity) OVER (PARTITION BY variant ORDER BY close_at, trade_id) AS top FROM eq),
  pa AS (SELECT *, greatest(top, 0) AS peak, CASE WHEN top > 0 THEN first_value(close_at) OVER (PARTITION BY variant, top ORDER BY CASE WHEN equity = top THEN 0 ELSE 1 END, close_at, trade_id) END AS peak_at FROM pk),
  dd AS (SELECT *, peak - equity AS drawdown FROM pa)"""


@query(
    "w10_drawdown",
    with_ctes(
        LED, CLOSED, EQ,
        """nr AS (SELECT *, lag(drawdown) OVER w AS pd, lag(peak_at) OVER w AS pp FROM dd WINDOW w AS (PARTITION BY variant ORDER BY close_at, trade_id)),
           ls AS (SELECT variant, arg_max(drawdown, (close_at, trade_id)) AS ld, arg_max(peak_at, (close_at, trade_id)) AS lp, max(close_at) AS lt FROM dd WHERE true GROUP BY 1)""",
        select="""SELECT variant, count(*) AS marks, max(drawdown)::DOUBLE AS max_drawdown, arg_max(peak_at, (drawdown, -epoch_us(close_at))) AS peak_at,
            arg_max(close_at, (drawdown, -epoch_us(close_at))) AS trough_at, CASE WHEN any_value(ld) = 0 THEN coalesce(max(CASE WHEN drawdown = 0 AND pd > 0 THEN (epoch_us(close_at) - epoch_us(pp)) / 1e6 END), 0) END AS recovery_seconds,
            CASE WHEN any_value(ld) > 0 THEN 'UNRECOVERED' ELSE 'RECOVERED' END AS recovery_state,
            CASE WHEN any_value(ld) > 0 THEN any_value(lp) END AS unrecovered_since FROM nr JOIN ls USING (variant) GROUP BY 1""",
    ),
)
def w10_drawdown(spark, sf):
    order = ["close_at", "trade_id"]
    led = I.closed_trades(spark, sf).select("variant", *order, "net")
    curve = L.equity_curve(led, ["variant"], order, "net", "close_at")
    return L.drawdown_summary(curve, ["variant"], order, "close_at").drop("unrecovered_seconds")


@query(
    "w10_equity_curve",
    with_ctes(LED, CLOSED, EQ, select="SELECT variant, trade_id, equity::DOUBLE AS equity, peak::DOUBLE AS peak, drawdown::DOUBLE AS drawdown FROM dd"),
)
def w10_equity_curve(spark, sf):
    order = ["close_at", "trade_id"]
    led = I.closed_trades(spark, sf).select("variant", *order, "net")
    return L.equity_curve(led, ["variant"], order, "net", "close_at").select("variant", "trade_id", "equity", "peak", "drawdown")


@query(
    "x8_history_continuity",
    with_ctes(
        SQL["ticks"], sql_strict_bars(3600),
        """r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY start DESC) AS rn FROM bars),
           l AS (SELECT *, start = coalesce(lag("end") OVER (PARTITION BY instrument ORDER BY start), start) AS ok FROM r WHERE rn <= 100)""",
        select="""SELECT instrument, count(*) AS bars, min(start) AS first_start, max("end") AS last_end, CASE WHEN count(*) >= 100 THEN 'COMPLETE' ELSE 'PARTIAL' END AS selection,
            CASE WHEN bool_and(ok) THEN 'CONTINUOUS' ELSE 'DISCONTINUOUS' END AS continuity FROM l GROUP BY 1""",
    ),
)
def x8_history_continuity(spark, sf):
    from tickloom.operators.bars import history_continuity

    return history_continuity(I.strict_bars(spark, sf), 100).drop("tf_seconds")


@query(
    "x9_position_sizing",
    with_ctes(
        *POINTS,
        """s AS (SELECT instrument, start, close, atr, CASE WHEN event_count % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS direction, atr * 1.5::DOUBLE AS sd, 10000.0::DOUBLE * 0.0025::DOUBLE AS budget FROM points WHERE ready),
           q AS (SELECT *, least(floor(greatest(budget - 1.0, 0.0) / (sd * 1.0 + 0.05::DOUBLE) / 0.01::DOUBLE) * 0.01::DOUBLE, floor(0.4::DOUBLE / 0.01::DOUBLE) * 0.01::DOUBLE) AS qty FROM s)""",
        select="""SELECT instrument, start, direction, round(qty, 4) AS quantity, round(sd, 6) AS stop_distance, round(CASE WHEN direction = 'UP' THEN close - sd ELSE close + sd END, 6) AS stop,
            round(CASE WHEN direction = 'UP' THEN close + atr * 3 ELSE close - atr * 3 END, 6) AS target,
            CASE WHEN qty < 0.1 THEN 'QUANTITY_BELOW_MIN,RISK_BUDGET_WOULD_BE_EXCEEDED' ELSE '' END AS reasons, round(qty * sd + 1.0 + qty * 0.05, 6) AS expected_loss_at_stop FROM q""",
    ),
)
def x9_position_sizing(spark, sf):
    rows = points(spark, sf).where("ready").withColumn("direction", F.when(F.col("event_count") % 2 == 0, "UP").otherwise("DOWN"))
    out = trade.sized_entries(
        rows, equity=F.lit(10000.0), fixed_cost=F.lit(1.0), variable_cost=F.lit(0.05), unit_value=F.lit(1.0),
        minimum=F.lit(0.1), maximum=F.lit(0.4), step=F.lit(0.01),
    )
    return out.select(
        "instrument", "start", "direction", rnd("quantity", 4), rnd("stop_distance"), rnd("stop"), rnd("target"), text_list("reasons"),
        rnd("expected_loss_at_stop"),
    )


@query(
    "x11_trade_pnl",
    with_ctes(
        LED,
        """p AS (SELECT *, (notional / 100)::DECIMAL(18,6) AS er, (notional / 100 * (1 + discount_rate))::DECIMAL(18,6) AS cr, CASE WHEN direction = 'UP' THEN 1 ELSE -1 END AS sg, (epoch_us(close_at) - epoch_us(entry_at)) / 1e6 AS secs FROM ledger),
           x AS (SELECT *, (er + sg * 0.01)::DECIMAL(18,6) AS ep, (cr - sg * 0.01)::DECIMAL(18,6) AS cp, CASE WHEN part_id % 11 <> 0 THEN 0.5 + 0.001 * units END AS comm FROM p),
           y AS (SELECT *, (cp - ep) * units * sg AS g, abs(ep * units)::DOUBLE * 1e-9::DOUBLE * secs AS fin FROM x),
           z AS (SELECT *, (comm::DECIMAL(30,8) + fin::DECIMAL(30,8))::DECIMAL(30,6) AS c FROM y)""",
        select="""SELECT trade_id, g::DECIMAL(30,6)::DOUBLE AS gross, c::DOUBLE AS cost, (g::DECIMAL(30,6) - c)::DOUBLE AS net,
            CASE WHEN comm IS NULL THEN 'COMMISSION_UNKNOWN' END AS pnl_reason FROM z""",
    ),
)
def x11_trade_pnl(spark, sf):
    led = I.ledger(spark, sf).drop("gross", "cost", "net").withColumns({
        "entry_reference": (F.col("notional") / 100).cast("decimal(18,6)"),
        "close_reference": (F.col("notional") / 100 * (1 + F.col("discount_rate"))).cast("decimal(18,6)"),
    })
    dec = lambda v, t: F.lit(v).cast(t)
    out = trade.trade_pnl(
        led, slippage=dec("0.01", "decimal(10,6)"), commission_fixed=F.when(F.col("part_id") % 11 != 0, dec("0.5", "decimal(10,4)")),
        commission_per_unit=dec("0.001", "decimal(10,4)"), financing_rate=F.lit(1e-9), conversion=dec("1", "decimal(10,4)"),
    )
    return out.select("trade_id", "gross", "cost", "net", "pnl_reason")


@query(
    "x14_settlement_state",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'UNKNOWN' END AS state, count(*) AS trades FROM orders GROUP BY 1""",
)
def x14_settlement_state(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", " settled").when(F.col("o_orderstatus") == "O", "Open").otherwise("?")
    return I.table(spark, sf, "orders").groupBy(trade.settlement_state(raw).alias("state")).agg(F.count(F.lit(1)).alias("trades"))


@query(
    "x16_fill_hypotheses",
    with_ctes(
        LED,
        select="""SELECT variant, h, sum(units)::DOUBLE AS requested, round(sum(CASE h WHEN 'FULL' THEN units::DOUBLE WHEN 'IOC_PARTIAL' THEN units::DOUBLE * 0.6 ELSE 0 END), 4) AS filled,
            round(sum(CASE h WHEN 'IOC_PARTIAL' THEN units::DOUBLE * 0.4 ELSE 0 END), 4) AS cancelled, sum(CASE h WHEN 'REJECTED' THEN units::DOUBLE ELSE 0 END) AS rejected
            FROM ledger, (VALUES ('FULL'), ('IOC_PARTIAL'), ('REJECTED')) v(h) GROUP BY 1, 2""",
    ),
)
def x16_fill_hypotheses(spark, sf):
    led = I.ledger(spark, sf).withColumn("h", F.explode(F.array(F.lit("FULL"), F.lit("IOC_PARTIAL"), F.lit("REJECTED"))))
    q = trade.filled_quantities(F.col("units").cast("double"), F.col("h"), F.lit(0.6))
    return led.groupBy("variant", "h").agg(*[F.round(F.sum(c), 4).alias(n) for n, c in q.items()])


@query(
    "x17_leakage_check",
    """SELECT 'close_before_entry' AS kind, count(*) AS trades FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
       UNION ALL SELECT 'entry_before_signal_available', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 3 = 0""",
)
def x17_leakage_check(spark, sf):
    li, o = I.table(spark, sf, "lineitem"), I.table(spark, sf, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", F.col("o_orderdate").cast("timestamp").alias("entry"), F.col("l_shipdate").cast("timestamp").alias("close"),
        (F.col("o_orderdate").cast("timestamp") + F.when(F.col("l_partkey") % 3 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))).alias("known"),
    )
    found = RW.leakage(rows, signal_known="known", entry="entry", close="close", ident="l_orderkey")
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("trades"))
