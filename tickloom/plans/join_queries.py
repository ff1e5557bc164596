"""Queries over as-of joins, interval questions, labels and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import near, plus_seconds
from tickloom.operators import bars as B
from tickloom.operators import book, intervals, outcomes, reconcile
from tickloom.operators import research_windows as RW
from tickloom.operators.asof import BACKWARD, FORWARD, latest_known, select_price
from tickloom.operators.signals import context_direction
from tickloom.plans import inputs as I
from tickloom.plans.indicator_queries import BASE, CROSS, H4, POINTS, SID, points, x2_rule_signals
from tickloom.plans.inputs import SQL, sql_bars, sql_strict_bars, with_ctes
from tickloom.plans.registry import query, rnd, text_list
from tickloom.session import exists, pin, scratch_path

HORIZONS = (3600.0, 14400.0)
RULE = outcomes.Contract(latency_seconds=2, max_age_seconds=3600, stake=10.0, payout=0.85, loss=1.0, cost=0.1)

SIGNALS = (
    *POINTS, CROSS,
    """ch AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS upper, min(low) OVER w AS lower,
         bool_and(closed AND valid) OVER w AS all_ok, max(available_at) OVER w AS known FROM bars
         WINDOW w AS (PARTITION BY instrument ORDER BY start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
       don AS (SELECT *, CASE WHEN close > upper THEN 'UP' WHEN close < lower THEN 'DOWN' END AS direction FROM ch
         WHERE closed AND valid AND n >= 20 AND all_ok AND known <= available_at)""",
    f"""sig AS (SELECT 'sig_' || {SID.format(s="donchian20")} AS signal_id, instrument, direction,
          available_at AS detected_at, 'donchian20' AS strategy FROM don WHERE direction IS NOT NULL
        UNION ALL SELECT 'sig_' || {SID.format(s="ema_cross")}, instrument, direction, available_at, 'ema_cross'
          FROM crossed WHERE direction IS NOT NULL)""",
)

LABELLED = (
    *SIGNALS,
    """ent0 AS (SELECT s.*, detected_at + INTERVAL 2 SECOND AS target, (SELECT min((p.event_time, p.available_at, p.seq, p.bid)) FROM quotes p
          WHERE p.instrument = s.instrument AND p.event_time >= s.detected_at + INTERVAL 2 SECOND) AS b FROM sig s),
       ent AS (SELECT *, CASE WHEN b IS NULL THEN 'PRICE_NOT_AVAILABLE'
          WHEN greatest(epoch_us(b[1]) - epoch_us(target), epoch_us(b[2]) - epoch_us(target), 0) / 1e6 > 3600 THEN 'MAX_PRICE_AGE_EXCEEDED' END AS entry_reason FROM ent0),
       ent2 AS (SELECT signal_id, instrument, direction, detected_at, strategy, entry_reason, CASE WHEN entry_reason IS NULL THEN b[1] END AS entry_time,
          CASE WHEN entry_reason IS NULL THEN b[4] END AS entry_price, CASE WHEN entry_reason IS NULL THEN greatest(target, b[2]) END AS entry_use_time FROM ent),
       hz AS (SELECT *, entry_use_time + to_seconds(horizon::BIGINT) AS expiry FROM ent2, (VALUES (3600.0::DOUBLE), (14400.0::DOUBLE)) h(horizon)),
       fin0 AS (SELECT h.*, (SELECT max((p.event_time, p.available_at, p.seq, p.bid)) FROM quotes p WHERE p.instrument = h.instrument
          AND p.event_time <= h.expiry AND p.available_at <= h.expiry + INTERVAL 1 HOUR AND p.event_time > h.entry_time) AS b FROM hz h),
       fin AS (SELECT *, CASE WHEN b IS NULL THEN 'PRICE_NOT_AVAILABLE'
          WHEN greatest(epoch_us(expiry) - epoch_us(b[1]), epoch_us(b[2]) - epoch_us(expiry), 0) / 1e6 > 3600 THEN 'MAX_PRICE_AGE_EXCEEDED' END AS final_reason FROM fin0),
       fin2 AS (SELECT *, CASE WHEN final_reason IS NULL THEN b[4] END AS final_price, CASE WHEN final_reason IS NULL THEN b[2] END AS final_available FROM fin),
       fin3 AS (SELECT *, CASE WHEN direction = 'UP' THEN final_price - entry_price ELSE entry_price - final_price END AS move FROM fin2),
       outc0 AS (SELECT *, CASE WHEN move IS NULL THEN 'INDETERMINATE' WHEN abs(move) <= 0 THEN 'TIE' WHEN move > 0 THEN 'WIN' ELSE 'LOSS' END AS outcome FROM fin3),
       outc AS (SELECT *, CASE outcome WHEN 'WIN' THEN 10.0::DOUBLE * 0.85::DOUBLE - 0.1::DOUBLE WHEN 'LOSS' THEN -10.0::DOUBLE * 1.0::DOUBLE - 0.1::DOUBLE WHEN 'TIE' THEN 0.0::DOUBLE - 0.1::DOUBLE END AS net,
          0.1::DOUBLE AS cost, coalesce(final_available, expiry, detected_at) AS settled_at, signal_id || ':' || horizon::BIGINT AS simulation_id,
          (10.0 * 1.0 + 0.1)::DOUBLE / (10.0 * (0.85 + 1.0))::DOUBLE AS break_even FROM outc0)""",
)


def labelled(spark, sf):
    """The labelled results; written once per application and input folder, and again when the pinned tables were dropped."""
    key = spark.sparkContext.applicationId, sf
    if key not in _LABELLED or not exists(spark, _LABELLED[key][0]):
        pts = outcomes.points_from_ticks(I.quotes(spark, sf), F.col("bid"))
        rows, path = outcomes.label(x2_rule_signals(spark, sf), pts, HORIZONS, RULE), scratch_path(spark, "labelled")
        rows.write.parquet(path)
        _LABELLED[key] = path, rows.schema
    path, schema = _LABELLED[key]
    return spark.read.schema(schema).parquet(path)


_LABELLED: dict[tuple[str, str], tuple] = {}


@query(
    "j1_latest_known_quote",
    with_ctes(
        *BASE,
        """m AS (SELECT b.*, (SELECT max((q.event_time, q.available_at, q.seq, q.bid)) FROM quotes q WHERE q.instrument = b.instrument
              AND q.event_time <= b.available_at AND q.available_at <= b.available_at) AS best FROM bars b)""",
        select="SELECT instrument, start, best[1] AS q_time, best[3] AS q_seq, best[4] AS q_bid FROM m",
    ),
)
def j1_latest_known_quote(spark, sf):
    rows = latest_known(
        I.bars(spark, sf).drop("quality_flags"), I.quotes(spark, sf), left_id=["start"], right_id=["seq"], values=["seq", "bid"]
    )
    return rows.select("instrument", "start", "q_time", "q_seq", "q_bid")


@query(
    "j2_price_selection",
    with_ctes(
        *SIGNALS,
        """f AS (SELECT s.*, (SELECT min((p.event_time, p.available_at, p.seq, p.bid)) FROM quotes p WHERE p.instrument = s.instrument AND p.event_time >= s.detected_at) AS b FROM sig s),
           k AS (SELECT s.*, (SELECT max((p.event_time, p.available_at, p.seq, p.bid)) FROM quotes p WHERE p.instrument = s.instrument AND p.event_time <= s.detected_at
                 AND p.available_at <= s.detected_at + INTERVAL 5 MINUTE) AS b FROM sig s),
           u AS (SELECT signal_id, 'forward' AS rule, b, greatest(epoch_us(b[1]) - epoch_us(detected_at), epoch_us(b[2]) - epoch_us(detected_at), 0) / 1e6 AS age FROM f
             UNION ALL SELECT signal_id, 'backward', b, greatest(epoch_us(detected_at) - epoch_us(b[1]), epoch_us(b[2]) - epoch_us(detected_at), 0) / 1e6 FROM k)""",
        select="""SELECT signal_id, rule, CASE WHEN b IS NOT NULL AND age <= 300 THEN b[4] END AS price, CASE WHEN b IS NOT NULL AND age <= 300 THEN round(age, 6) END AS age,
             CASE WHEN b IS NULL THEN 'PRICE_NOT_AVAILABLE' WHEN age > 300 THEN 'MAX_PRICE_AGE_EXCEEDED' END AS reason FROM u""",
    ),
)
def j2_price_selection(spark, sf):
    sig = x2_rule_signals(spark, sf)
    pts = outcomes.points_from_ticks(I.quotes(spark, sf), F.col("bid"))
    got = []
    for name, rule in (("forward", FORWARD), ("backward", BACKWARD)):
        one = select_price(sig, pts, target="detected_at", target_id=["signal_id"], rule=rule, max_age=300)
        got.append(one.select("signal_id", F.lit(name).alias("rule"), "price", rnd("age"), "reason"))
    return got[0].unionByName(got[1])


@query(
    "j3_context_at_trigger",
    with_ctes(
        *POINTS,
        """ctx AS (SELECT *, lag(ema_slow, 3) OVER w AS lag_slow, lag(valid, 3) OVER w AS lag_ok, greatest(available_at, lag(available_at, 3) OVER w) AS known_at FROM points
             WINDOW w AS (PARTITION BY instrument ORDER BY start)),
           c2 AS (SELECT *, CASE WHEN NOT (valid AND lag_ok) THEN NULL WHEN ema_fast > ema_slow AND ema_slow > lag_slow THEN 'UP'
                 WHEN ema_fast < ema_slow AND ema_slow < lag_slow THEN 'DOWN' END AS dir FROM ctx)""",
        sql_bars(2 * 3600, "small"),
        """best AS (SELECT t.instrument, t.start, max_by((c.start, coalesce(c.dir, '-')), (c.start, c.known_at)) AS c FROM small t JOIN c2 c
             ON c.instrument = t.instrument AND c.start <= t.available_at AND c.known_at <= t.available_at GROUP BY 1, 2)""",
        select="SELECT t.instrument, t.start, c[1] AS context_start, c[2] AS context_direction FROM small t LEFT JOIN best b USING (instrument, start)",
    ),
)
def j3_context_at_trigger(spark, sf):
    ctx = context_direction(points(spark, sf)).select(
        "instrument", "start", "context_available", F.coalesce("context_direction", F.lit("-")).alias("dir")
    )
    trig = I.bars(spark, sf, 2 * 3600).select("instrument", "start", "available_at")
    rows = latest_known(
        trig, ctx, left_id=["start"], time="start", available="context_available", right_id=[], values=["dir"], prefix="c_"
    )
    return rows.select("instrument", "start", F.col("c_time").alias("context_start"), F.col("c_dir").alias("context_direction"))


@query(
    "j4_bar_reconciliation",
    with_ctes(
        SQL["ticks"], sql_strict_bars(3600),
        """nat AS (SELECT instrument, tf_seconds, start, open, high, low, CASE WHEN event_count = 3 THEN close + 0.5 ELSE close END AS close, closed, event_count AS n
             FROM bars WHERE event_count <> 1 UNION ALL SELECT instrument, tf_seconds, start, open, high, low, close, closed, event_count FROM bars WHERE event_count = 6
             UNION ALL SELECT instrument, tf_seconds, start + INTERVAL 400 DAY, open, high, low, close, closed, event_count FROM bars WHERE event_count = 7),
           reb AS (SELECT * FROM bars),
           n1 AS (SELECT instrument, tf_seconds, start, any_value(close) AS close, any_value(n) AS n, bool_and(closed) AS closed, count(*) AS copies FROM nat GROUP BY 1, 2, 3)""",
        select="""SELECT coalesce(n1.instrument, reb.instrument) AS instrument, coalesce(n1.start, reb.start) AS start,
             CASE WHEN n1.copies > 1 THEN 'BLOCKED' WHEN NOT coalesce(n1.closed, true) OR NOT coalesce(reb.closed, true) THEN 'BLOCKED' WHEN n1.start IS NULL THEN 'MISSING_NATIVE'
                  WHEN reb.start IS NULL THEN 'MISSING_EVENTS' WHEN n1.n = 3 THEN 'MISMATCH' ELSE 'MATCH' END AS state,
             CASE WHEN n1.copies > 1 THEN 'duplicate' WHEN NOT coalesce(n1.closed, true) OR NOT coalesce(reb.closed, true) THEN 'open_bar' WHEN n1.n = 3 AND reb.start IS NOT NULL THEN 'close' ELSE '' END AS reasons
             FROM n1 FULL OUTER JOIN reb ON n1.instrument = reb.instrument AND n1.start = reb.start""",
    ),
)
def j4_bar_reconciliation(spark, sf):
    rebuilt, n = I.strict_bars(spark, sf), F.col("event_count")
    native = rebuilt.where(n != 1).withColumn("close", F.when(n == 3, F.col("close") + 0.5).otherwise(F.col("close")))
    native = native.unionByName(rebuilt.where(n == 6)).unionByName(
        rebuilt.where(n == 7).withColumn("start", F.col("start") + F.expr("INTERVAL 400 DAYS"))
    )
    return reconcile.reconcile_bars(native, rebuilt).select("instrument", "start", "state", text_list("reasons"))


def marked_trades(spark, sf):
    """Labelled results as trades: entered at the use time, closed at the expiry."""
    out = labelled(spark, sf).where(F.col("entry_price").isNotNull())
    return out.select(
        F.col("simulation_id").alias("trade_id"), "instrument", "direction", F.col("entry_use_time").alias("entry_at"),
        F.col("expiry").alias("close_at"), "entry_price", F.col("horizon"), "net",
    )


TRADES = (*LABELLED, """trades AS (SELECT simulation_id AS trade_id, instrument, direction, entry_use_time AS entry_at, expiry AS close_at, entry_price, horizon, net FROM outc WHERE entry_price IS NOT NULL)""")


@query(
    "j5_quotes_within_trade",
    with_ctes(
        *TRADES,
        select="""SELECT trade_id, max(q.bid) AS bid_max, min(q.bid) AS bid_min, round(max(q.ask), 6) AS ask_max, round(min(q.ask), 6) AS ask_min
             FROM trades t JOIN quotes q ON q.instrument = t.instrument AND q.event_time BETWEEN t.entry_at AND t.close_at GROUP BY 1""",
    ),
)
def j5_quotes_within_trade(spark, sf):
    out = intervals.extremes(marked_trades(spark, sf), I.quotes(spark, sf), ["trade_id"], start="entry_at", end="close_at")
    return out.select("trade_id", "bid_max", "bid_min", rnd("ask_max"), rnd("ask_min"))


@query(
    "a31_mfe_mae",
    with_ctes(
        *TRADES,
        select="""SELECT trade_id, round(max(CASE WHEN direction = 'UP' THEN q.bid - entry_price ELSE entry_price - q.ask END), 6) AS mfe,
             round(min(CASE WHEN direction = 'UP' THEN q.bid - entry_price ELSE entry_price - q.ask END), 6) AS mae
             FROM trades t JOIN quotes q ON q.instrument = t.instrument AND q.event_time BETWEEN t.entry_at AND t.close_at GROUP BY 1""",
    ),
)
def a31_mfe_mae(spark, sf):
    out = intervals.excursions(marked_trades(spark, sf), I.quotes(spark, sf), "trade_id")
    return out.select("trade_id", rnd("mfe"), rnd("mae"))


@query(
    "a31_mfe_mae_continued",
    with_ctes(
        *TRADES,
        """h AS (SELECT *, (epoch_us(close_at) - epoch_us(entry_at)) // 2 AS half, epoch_us(entry_at) AS s, epoch_us(close_at) AS e FROM trades),
           m AS (SELECT h.trade_id, q.event_time, epoch_us(q.event_time) AS us, h.s, h.e, h.half, CASE WHEN direction = 'UP' THEN q.bid - entry_price ELSE entry_price - q.ask END AS move
              FROM h JOIN quotes q ON q.instrument = h.instrument AND epoch_us(q.event_time) BETWEEN h.s AND h.e)""",
        select="SELECT trade_id, round(max(move), 6) AS mfe, round(min(move), 6) AS mae FROM m GROUP BY 1",
    ),
)
def a31_mfe_mae_continued(spark, sf):
    """Excursions in two parts: the first half's values are the explicit start of the second half."""
    trades, q = marked_trades(spark, sf), I.quotes(spark, sf)
    half = F.floor((F.unix_micros("close_at") - F.unix_micros("entry_at")) / 2)
    trades = trades.withColumn("middle", F.timestamp_micros(F.unix_micros("entry_at") + half))
    early = intervals.excursions(trades, q, "trade_id", close="middle").select("trade_id", F.col("mfe").alias("mfe_before"), F.col("mae").alias("mae_before"))
    late = trades.join(early, "trade_id", "left").withColumn("after", F.timestamp_micros(F.unix_micros("middle") + 1))
    out = intervals.excursions(late, q, "trade_id", entry="after", start_mfe="mfe_before", start_mae="mae_before")
    return out.select("trade_id", rnd("mfe"), rnd("mae"))


@query(
    "x10_first_touch_exit",
    with_ctes(
        *TRADES,
        """b AS (SELECT *, CASE WHEN direction = 'UP' THEN entry_price - 20 ELSE entry_price + 20 END AS stop,
              CASE WHEN direction = 'UP' THEN entry_price + 40 ELSE entry_price - 40 END AS target FROM trades),
           q2 AS (SELECT b.*, q.event_time, CASE WHEN direction = 'UP' THEN q.bid ELSE q.ask END AS px FROM b LEFT JOIN quotes q
              ON q.instrument = b.instrument AND q.event_time BETWEEN b.entry_at AND b.close_at),
           f AS (SELECT trade_id, close_at, min(CASE WHEN direction = 'UP' AND px <= stop OR direction = 'DOWN' AND px >= stop THEN event_time END) AS stop_at,
              min(CASE WHEN direction = 'UP' AND px >= target OR direction = 'DOWN' AND px <= target THEN event_time END) AS target_at, any_value(instrument) AS instrument FROM q2 GROUP BY 1, 2),
           gp AS (SELECT instrument, event_time, (epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY instrument ORDER BY event_time, seq))) / 1e6 AS gap FROM quotes)""",
        select="""SELECT trade_id, coalesce((SELECT max(gap) FROM gp WHERE gp.instrument = f.instrument AND gp.event_time = coalesce(least(stop_at, target_at))) > 1800, false) AS gap, CASE WHEN stop_at IS NOT NULL AND (target_at IS NULL OR stop_at <= target_at) THEN 'STOP' WHEN target_at IS NOT NULL THEN 'TARGET' ELSE 'TIME' END AS exit,
              coalesce(least(stop_at, target_at), close_at) AS exit_at FROM f""",
    ),
)
def x10_first_touch_exit(spark, sf):
    from tickloom.operators.exits import first_touch

    up, e = F.col("direction") == "UP", F.col("entry_price")
    trades = marked_trades(spark, sf).withColumns({
        "stop": F.when(up, e - 20).otherwise(e + 20), "target": F.when(up, e + 40).otherwise(e - 40)
    })
    return first_touch(trades, I.quotes(spark, sf), "trade_id", gap_bound=1800).select("trade_id", "exit", "exit_at", "gap")


@query(
    "x10_time_limits",
    with_ctes(
        *TRADES,
        """n AS (SELECT *, lead("end", 2) OVER (PARTITION BY instrument ORDER BY start) AS lim FROM bars),
           e AS (SELECT t.*, (SELECT max((n.start, n.lim)) FROM n WHERE n.instrument = t.instrument AND n.start <= t.entry_at) AS b FROM trades t),
           l AS (SELECT *, timezone('America/New_York', timezone('UTC', entry_at)) AS loc FROM e),
           w AS (SELECT *, ((4 - (isodow(loc) - 1)) % 7 + 7) % 7 AS d, epoch_us(loc) % 86400000000 / 1e6 AS sec FROM l),
           c AS (SELECT *, greatest(entry_at, timezone('UTC', timezone('America/New_York', date_trunc('day', loc) + to_days((CASE WHEN d = 0 AND sec >= 60900 THEN 7 ELSE d END)::INT) + INTERVAL 60900 SECOND)) - INTERVAL 60 MINUTE) AS cut,
              b[2] AS by_bars, entry_at + INTERVAL 10 HOUR AS by_hours FROM w)""",
        select="""SELECT trade_id, least(by_bars, by_hours, cut) AS close_at, CASE WHEN by_bars = least(by_bars, by_hours, cut) THEN 'MAX_BARS' WHEN by_hours = least(by_bars, by_hours, cut) THEN 'MAX_HOURS'
              ELSE 'PRE_WEEKLY_CLOSE' END AS time_reason FROM c""",
    ),
)
def x10_time_limits(spark, sf):
    from tickloom.operators.exits import time_limits

    trades = marked_trades(spark, sf).drop("close_at")
    out = time_limits(trades, I.bars(spark, sf), "trade_id", max_bars=2, max_hours=10, preclose_minutes=60)
    return out.select("trade_id", "close_at", "time_reason")


@query(
    "x15_mark_to_market",
    with_ctes(
        *TRADES,
        """tr AS (SELECT *, CASE WHEN direction = 'UP' THEN 1 ELSE -1 END AS sg, 10.0::DOUBLE AS units FROM trades)""",
        select="""SELECT q.instrument, q.seq,
              round(coalesce(sum(CASE WHEN t.close_at <= q.event_time THEN t.net END), 0), 6) AS realised,
              count(*) FILTER (t.close_at <= q.event_time AND t.net IS NULL) AS unknown_closed,
              round(coalesce(sum(CASE WHEN t.entry_at <= q.event_time AND t.close_at > q.event_time THEN (CASE WHEN sg = 1 THEN q.bid ELSE q.ask END - entry_price) * sg * units END), 0), 6) AS unrealised,
              round(coalesce(sum(CASE WHEN t.entry_at <= q.event_time AND t.close_at > q.event_time THEN (CASE WHEN sg = 1 THEN q.bid ELSE q.ask END) * units END), 0), 6) AS exposure
              FROM quotes q LEFT JOIN tr t ON t.instrument = q.instrument AND t.entry_at <= q.event_time GROUP BY 1, 2""",
    ),
)
def x15_mark_to_market(spark, sf):
    from tickloom.operators.exits import mark_to_market

    trades = marked_trades(spark, sf).withColumn("units", F.lit(10.0))
    out = mark_to_market(trades, I.quotes(spark, sf))
    return out.select("instrument", "seq", rnd("realised"), "unknown_closed", rnd("unrealised"), rnd("exposure"))


@query(
    "j6_trade_in_window",
    with_ctes(
        SQL["ledger"],
        """b AS (SELECT epoch_us(min(entry_at)) AS lo, epoch_us(max(entry_at)) - epoch_us(min(entry_at)) AS sp FROM ledger),
           w AS (SELECT 'walkforward_' || (i + 1) AS win, lo + round(sp * (0.4::DOUBLE + i * 0.1::DOUBLE))::BIGINT AS ts, lo + round(sp * (0.4::DOUBLE + i * 0.1::DOUBLE + 0.1::DOUBLE))::BIGINT AS te FROM b, range(4) r(i)
             UNION ALL SELECT 'holdout', lo + round(sp * (1.0::DOUBLE - 0.2::DOUBLE))::BIGINT, lo + sp FROM b)""",
        select="""SELECT win AS "window", CASE WHEN epoch_us(entry_at) < ts OR epoch_us(close_at) > te THEN 'PURGED' ELSE 'OOS' END AS placement,
             epoch_us(entry_at) > te AND epoch_us(entry_at) <= te + 86400000000 * 5 AS embargoed, count(*) AS trades FROM ledger, w GROUP BY ALL""",
    ),
)
def j6_trade_in_window(spark, sf):
    led = I.ledger(spark, sf)
    wins = RW.windows_for(led, "entry_at", embargo_seconds=5 * 86400)
    return RW.assign_windows(led, wins).groupBy("window", "placement", "embargoed").agg(F.count(F.lit(1)).alias("trades"))


@query(
    "j7_outcome_signal_instrument",
    with_ctes(*LABELLED, select="SELECT simulation_id, sig.instrument, sig.strategy FROM outc JOIN sig USING (signal_id)"),
)
def j7_outcome_signal_instrument(spark, sf):
    out = labelled(spark, sf).select("simulation_id", "signal_id")
    sig = x2_rule_signals(spark, sf).select("signal_id", "instrument", "strategy")
    return out.join(sig, "signal_id", "left").drop("signal_id")


@query(
    "j8_signal_membership",
    with_ctes(
        *SIGNALS,
        """mem AS (SELECT signal_id, 'all' AS analysis FROM sig UNION ALL SELECT signal_id, strategy FROM sig UNION ALL SELECT signal_id, 'up' FROM sig WHERE direction = 'UP')""",
        select="SELECT analysis, instrument, count(*) AS signals FROM sig JOIN mem USING (signal_id) GROUP BY ALL",
    ),
)
def j8_signal_membership(spark, sf):
    sig = x2_rule_signals(spark, sf)
    member = lambda c, rows: rows.select("signal_id", c.alias("analysis"))
    bridge = member(F.lit("all"), sig).unionByName(member(F.col("strategy"), sig)).unionByName(
        member(F.lit("up"), sig.where("direction = 'UP'"))
    )
    return sig.join(bridge, "signal_id").groupBy("analysis", "instrument").agg(F.count(F.lit(1)).alias("signals"))


def one_sided(spark, sf):
    t = I.ticks(spark, sf)
    return t.select(
        "instrument", (F.col("seq") * 10 + (F.col("seq") % 7) * 15).alias("arrival"),
        F.when(F.col("seq") % 2 == 0, "bid").otherwise("ask").alias("side"), "price", F.unix_micros("event_time").alias("us"),
    )


@query(
    "j9_quote_book",
    """WITH RECURSIVE u AS (SELECT event_type AS instrument, event_id * 10 + (event_id % 7) * 15 AS arrival, event_id % 2 = 0 AS is_bid, value AS px, epoch_us(ts) AS us,
          row_number() OVER (PARTITION BY event_type ORDER BY event_id * 10 + (event_id % 7) * 15) AS rn FROM events),
        r AS (SELECT instrument, 0::BIGINT AS rn, 0::BIGINT AS arrival, NULL::DOUBLE AS bid, NULL::DOUBLE AS ask, NULL::BIGINT AS bu, NULL::BIGINT AS au, '' AS status FROM (SELECT DISTINCT instrument FROM u)
          UNION ALL SELECT u.instrument, u.rn, u.arrival,
            CASE WHEN x.ok AND u.is_bid THEN u.px ELSE r.bid END, CASE WHEN x.ok AND NOT u.is_bid THEN u.px ELSE r.ask END,
            CASE WHEN x.ok AND u.is_bid THEN u.us ELSE r.bu END, CASE WHEN x.ok AND NOT u.is_bid THEN u.us ELSE r.au END,
            CASE WHEN x.ok THEN 'APPLIED' WHEN x.old THEN 'OUT_OF_ORDER' ELSE 'CROSSED' END
          FROM r JOIN u ON u.instrument = r.instrument AND u.rn = r.rn + 1,
          LATERAL (SELECT coalesce(u.us < CASE WHEN u.is_bid THEN r.bu ELSE r.au END, false) AS old,
            NOT coalesce(u.us < CASE WHEN u.is_bid THEN r.bu ELSE r.au END, false)
            AND NOT coalesce(CASE WHEN u.is_bid THEN r.ask < u.px ELSE u.px < r.bid END, false) AS ok) x)
        SELECT instrument, arrival, bid, ask, status FROM r WHERE rn > 0""",
)
def j9_quote_book(spark, sf):
    return book.quote_book(one_sided(spark, sf), ["instrument"], "arrival").select("instrument", "arrival", "bid", "ask", "status")


@query(
    "j9_quote_book_windowed",
    """WITH u AS (SELECT event_type AS instrument, event_id AS arrival, event_id % 2 = 0 AS is_bid, CASE WHEN event_id % 2 = 0 THEN value - 1000 ELSE value END AS px FROM events)
       SELECT instrument, arrival, last_value(CASE WHEN is_bid THEN px END IGNORE NULLS) OVER w AS bid, last_value(CASE WHEN NOT is_bid THEN px END IGNORE NULLS) OVER w AS ask, true AS exact
       FROM u WINDOW w AS (PARTITION BY instrument ORDER BY arrival ROWS UNBOUNDED PRECEDING)""",
)
def j9_quote_book_windowed(spark, sf):
    src = I.ticks(spark, sf).select(
        "instrument", F.col("seq").alias("arrival"), F.when(F.col("seq") % 2 == 0, "bid").otherwise("ask").alias("side"),
        F.when(F.col("seq") % 2 == 0, F.col("price") - 1000).otherwise(F.col("price")).alias("price"), F.unix_micros("event_time").alias("us"),
    )
    return book.quote_book_windowed(src, ["instrument"], "arrival")


@query(
    "j10_open_quantity",
    with_ctes(
        SQL["ledger"],
        """m AS (SELECT DISTINCT instrument, date_trunc('month', close_at)::TIMESTAMP AS at FROM ledger)""",
        select="""SELECT m.instrument, m.at, coalesce(sum(units), 0)::DOUBLE AS open_units FROM m LEFT JOIN ledger l ON l.instrument = m.instrument
              AND l.entry_at <= m.at AND m.at < l.close_at GROUP BY 1, 2""",
    ),
)
def j10_open_quantity(spark, sf):
    led = pin(I.ledger(spark, sf).select("instrument", "entry_at", "close_at", "units"))
    marks = led.select("instrument", F.date_trunc("month", "close_at").alias("at")).distinct()
    out = intervals.level_at(
        led, marks, {"units": F.col("units")}, key=["instrument"], entry="entry_at", close="close_at", mark_at="at", mark_id="at",
    )
    return out.select("instrument", "at", F.coalesce(F.col("open_units").cast("double"), F.lit(0.0)).alias("open_units"))


@query(
    "j11_common_blocks",
    with_ctes(
        SQL["ledger"],
        """b AS (SELECT DISTINCT instrument, floor(date_diff('day', DATE '1970-01-01', close_at::DATE) / 14)::BIGINT AS block FROM ledger WHERE net IS NOT NULL),
           n AS (SELECT count(DISTINCT instrument) AS n FROM b)""",
        select="SELECT block FROM b, n GROUP BY block, n HAVING count(*) = n",
    ),
)
def j11_common_blocks(spark, sf):
    led = I.ledger(spark, sf).where("net IS NOT NULL")
    return reconcile.common_blocks(led, "instrument", "close_at", 14)


@query(
    "j12_known_and_new_keys",
    """SELECT count(*) FILTER (o_orderkey % 3 = 0) AS unknown, count(*) FILTER (o_orderkey % 3 <> 0) AS known FROM orders""",
)
def j12_known_and_new_keys(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey")
    stored = o.where(F.col("o_orderkey") % 3 != 0)
    new = o.join(stored, "o_orderkey", "left_anti").select(F.lit("new").alias("k"))
    old = o.join(stored, "o_orderkey", "left_semi").select(F.lit("old").alias("k"))
    return new.unionByName(old).agg(F.count_if(F.col("k") == "new").alias("unknown"), F.count_if(F.col("k") == "old").alias("known"))


@query(
    "j13_comparable_experiments",
    """SELECT p_brand AS variant, p_type AS horizon, count(*) AS trials, round(avg(p_retailprice), 6) AS net FROM part
       WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM part)) GROUP BY 1, 2""",
)
def j13_comparable_experiments(spark, sf):
    p = I.table(spark, sf, "part")
    runs = p.groupBy(F.col("p_brand").alias("variant"), F.col("p_type").alias("horizon")).agg(
        F.count(F.lit(1)).alias("trials"), F.round(F.avg("p_retailprice"), 6).alias("net")
    )
    kinds = p.agg(F.count_distinct("p_type")).scalar()
    full = p.groupBy(F.col("p_brand").alias("variant")).agg(F.count_distinct("p_type").alias("k")).where(F.col("k") == kinds)
    return runs.join(full.select("variant"), "variant", "left_semi")


IDENTITY = ("product", "instrument", "data_hash", "execution_model")


@query(
    "j13_identity_check",
    with_ctes(
        *LABELLED,
        """r AS (SELECT instrument, strategy, horizon, count(*) AS trials, round(sum(net) * 100)::BIGINT AS cents FROM outc GROUP BY ALL),
           h AS (SELECT instrument, count(*) || ':' || max(seq) AS data_hash FROM quotes GROUP BY 1),
           x AS (SELECT *, 'fixed' AS product, CASE strategy WHEN 'ema_cross' THEN 'touch' ELSE 'close' END AS execution_model FROM r LEFT JOIN h USING (instrument)),
           c AS (SELECT 'instrument ' || instrument AS comparison, * FROM x UNION ALL SELECT 'strategy ' || strategy, * FROM x UNION ALL SELECT 'pair ' || instrument || ' ' || strategy, * FROM x),
           g AS (SELECT comparison, count(*) AS runs, count(DISTINCT instrument) AS i, count(DISTINCT data_hash) AS d, count(DISTINCT execution_model) AS e,
              string_agg(strategy || '/' || instrument || '/' || horizon::BIGINT || '=' || cents, ',' ORDER BY strategy, instrument, horizon) AS results FROM c GROUP BY 1)""",
        select="""SELECT comparison, CASE WHEN i = 1 AND d = 1 AND e = 1 THEN 'COMPARED' ELSE 'INCOMPATIBLE' END AS state,
             concat_ws(',', CASE WHEN i > 1 THEN 'instrument' END, CASE WHEN d > 1 THEN 'data_hash' END, CASE WHEN e > 1 THEN 'execution_model' END) AS mismatches, runs,
             CASE WHEN i = 1 AND d = 1 AND e = 1 THEN results END AS results FROM g""",
    ),
)
def j13_identity_check(spark, sf):
    """Trials compared within an instrument, within a strategy, and within both: only the last share data and execution model."""
    from tickloom.operators.comparisons import compare

    trials = labelled(spark, sf).groupBy("instrument", "strategy", "horizon").agg(F.count(F.lit(1)).alias("trials"), F.round(F.sum("net") * 100).cast("bigint").alias("cents"))
    data = I.quotes(spark, sf).groupBy("instrument").agg(F.concat_ws(":", F.count(F.lit(1)), F.max("seq")).alias("data_hash"))
    runs = trials.join(data, "instrument", "left").withColumns({
        "product": F.lit("fixed"), "execution_model": F.when(F.col("strategy") == "ema_cross", "touch").otherwise("close"),
        "variant": F.struct("strategy", "instrument", F.col("horizon").cast("bigint").alias("horizon")),
    })
    names = F.array(F.concat_ws(" ", F.lit("instrument"), "instrument"), F.concat_ws(" ", F.lit("strategy"), "strategy"), F.concat_ws(" ", F.lit("pair"), "instrument", "strategy"))
    out = compare(runs.withColumn("comparison", F.explode(names)), ["comparison"], IDENTITY, "variant", ["cents"])
    shown = F.transform("side_by_side", lambda r: F.concat(F.concat_ws("/", r["variant"]["strategy"], r["variant"]["instrument"], r["variant"]["horizon"].cast("string")), F.lit("="), r["cents"].cast("string")))
    return out.select("comparison", "state", text_list("mismatches"), "runs", F.array_join(shown, ",").alias("results"))


@query(
    "x4_forward_outcomes",
    with_ctes(*LABELLED, select="""SELECT simulation_id, instrument, direction, horizon, entry_price, final_price, entry_use_time, expiry, outcome, round(net, 6) AS net,
              CASE WHEN move IS NULL THEN coalesce(entry_reason, final_reason) END AS reason FROM outc"""),
)
def x4_forward_outcomes(spark, sf):
    return labelled(spark, sf).select(
        "simulation_id", "instrument", "direction", "horizon", "entry_price", "final_price", "entry_use_time", "expiry", "outcome",
        rnd("net"), "reason",
    )


@query(
    "x5_leakage_safe_split",
    with_ctes(
        *LABELLED,
        select="""SELECT CASE WHEN detected_at >= TIMESTAMP '2024-01-20' THEN 'EVALUATION'
             WHEN coalesce(expiry, detected_at) <= TIMESTAMP '2024-01-20' AND coalesce(final_available, expiry, detected_at) <= TIMESTAMP '2024-01-20' THEN 'EXPLORATION'
             ELSE 'PURGED' END AS part, horizon, count(*) AS results FROM outc GROUP BY ALL""",
    ),
)
def x5_leakage_safe_split(spark, sf):
    part = outcomes.research_part(F.lit("2024-01-20").cast("timestamp"))
    return labelled(spark, sf).groupBy(part.alias("part"), "horizon").agg(F.count(F.lit(1)).alias("results"))


@query(
    "x12_points_from_bars",
    with_ctes(SQL["ticks"], sql_strict_bars(3600), select="""SELECT instrument, "end" AS event_time, available_at, close AS price FROM bars WHERE closed"""),
)
def x12_points_from_bars(spark, sf):
    return outcomes.points_from_bars(I.strict_bars(spark, sf)).select("instrument", "event_time", "available_at", "price")


AGG = """count(*) AS sample, count(*) FILTER (outcome = 'WIN') AS win, count(*) FILTER (outcome = 'LOSS') AS loss, count(*) FILTER (outcome = 'TIE') AS tie,
   count(*) FILTER (outcome = 'INDETERMINATE') AS indeterminate, count(*) FILTER (outcome IN ('WIN', 'LOSS', 'TIE')) AS resolved,
   round(coalesce(sum(net), 0), 6) AS net_result, round(coalesce(sum(CASE WHEN net + cost > 0 THEN net + cost END), 0), 6) AS gross_wins,
   round(coalesce(sum(CASE WHEN net + cost < 0 THEN net + cost END), 0), 6) AS gross_losses,
   round(count(*) FILTER (outcome = 'WIN')::DOUBLE / nullif(count(*) FILTER (outcome IN ('WIN', 'LOSS', 'TIE')), 0), 6) AS win_rate,
   round(avg(break_even), 6) AS break_even"""
AGG_COLUMNS = ["sample", "win", "loss", "tie", "indeterminate", "resolved"]
AGG_ROUNDED = ["net_result", "gross_wins", "gross_losses", "win_rate", "break_even", "max_drawdown"]


@query(
    "a9_outcome_aggregate",
    with_ctes(
        *LABELLED,
        """cum AS (SELECT strategy, settled_at, simulation_id, sum(net) OVER w AS eq FROM outc WHERE net IS NOT NULL WINDOW w AS (PARTITION BY strategy ORDER BY settled_at, simulation_id)),
           pk AS (SELECT strategy, greatest(max(eq) OVER (PARTITION BY strategy ORDER BY settled_at, simulation_id), 0) - eq AS dd FROM cum),
           mdd AS (SELECT strategy, max(dd) AS dd FROM pk GROUP BY 1)""",
        select=f"SELECT strategy, round(max(mdd.dd), 6) AS max_drawdown, {AGG} FROM outc LEFT JOIN mdd USING (strategy) GROUP BY strategy",
    ),
)
def a9_outcome_aggregate(spark, sf):
    return outcomes.aggregate(labelled(spark, sf), ["strategy"]).select("strategy", *AGG_COLUMNS, *map(rnd, AGG_ROUNDED))


@query(
    "a10_outcome_segments",
    with_ctes(
        *LABELLED,
        """o2 AS (SELECT *, horizon::VARCHAR AS hz_text FROM outc),
           g AS (SELECT 'strategy+instrument+horizon' AS grouping, strategy, instrument, hz_text AS horizon, net, cost, outcome, break_even, settled_at, simulation_id FROM o2
             UNION ALL SELECT 'strategy', strategy, '*', '*', net, cost, outcome, break_even, settled_at, simulation_id FROM o2
             UNION ALL SELECT 'instrument', '*', instrument, '*', net, cost, outcome, break_even, settled_at, simulation_id FROM o2
             UNION ALL SELECT 'horizon', '*', '*', hz_text, net, cost, outcome, break_even, settled_at, simulation_id FROM o2
             UNION ALL SELECT 'total', '*', '*', '*', net, cost, outcome, break_even, settled_at, simulation_id FROM o2),
           cum AS (SELECT grouping, strategy, instrument, horizon, settled_at, simulation_id, sum(net) OVER (PARTITION BY grouping, strategy, instrument, horizon ORDER BY settled_at, simulation_id) AS eq FROM g WHERE net IS NOT NULL),
           pk AS (SELECT grouping, strategy, instrument, horizon, greatest(max(eq) OVER (PARTITION BY grouping, strategy, instrument, horizon ORDER BY settled_at, simulation_id), 0) - eq AS dd FROM cum),
           mdd AS (SELECT grouping, strategy, instrument, horizon, max(dd) AS dd FROM pk GROUP BY ALL)""",
        select=f"""SELECT grouping, strategy, instrument, horizon, round(max(mdd.dd), 6) AS max_drawdown, {AGG} FROM g LEFT JOIN mdd USING (grouping, strategy, instrument, horizon)
                   GROUP BY grouping, strategy, instrument, horizon""",
    ),
)
def a10_outcome_segments(spark, sf):
    out = outcomes.segments(labelled(spark, sf), ["strategy", "instrument", "horizon"])
    return out.select("grouping", "strategy", "instrument", "horizon", *AGG_COLUMNS, *map(rnd, AGG_ROUNDED))


@query(
    "a11_outcome_counters",
    with_ctes(
        *LABELLED,
        select="""SELECT 'outcome' AS counter, outcome AS label, count(*) AS n FROM outc GROUP BY 1, 2
            UNION ALL SELECT 'reason', coalesce(entry_reason, final_reason), count(*) FROM outc WHERE move IS NULL GROUP BY 1, 2""",
    ),
)
def a11_outcome_counters(spark, sf):
    pairs = F.array_compact(F.array(
        F.struct(F.lit("outcome").alias("counter"), F.col("outcome").alias("label")),
        F.when(F.col("reason").isNotNull(), F.struct(F.lit("reason").alias("counter"), F.col("reason").alias("label"))),
    ))
    return labelled(spark, sf).select(F.explode(pairs).alias("p")).groupBy("p.counter", "p.label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a37_variant_summary",
    with_ctes(
        *LABELLED,
        """so AS (SELECT strategy, signal_id, detected_at, row_number() OVER (PARTITION BY strategy ORDER BY detected_at, signal_id) AS rn FROM sig),
           fold AS (SELECT strategy, rn, detected_at AS anchor, 1 AS new FROM so WHERE rn = 1
             UNION ALL SELECT s.strategy, s.rn, CASE WHEN epoch_us(s.detected_at) - epoch_us(f.anchor) > 86400000000 THEN s.detected_at ELSE f.anchor END,
               CASE WHEN epoch_us(s.detected_at) - epoch_us(f.anchor) > 86400000000 THEN 1 ELSE 0 END FROM fold f JOIN so s ON s.strategy = f.strategy AND s.rn = f.rn + 1),
           grp AS (SELECT strategy, sum(new)::BIGINT AS independent_groups FROM fold GROUP BY 1)""",
        select="""SELECT strategy, count(DISTINCT signal_id) AS signals, min(detected_at) AS first_signal, max(detected_at) AS last_signal,
             count(*) FILTER (outcome = 'WIN') AS win, count(*) FILTER (outcome = 'LOSS') AS loss, round(sum(net), 6) AS net_result, any_value(independent_groups) AS independent_groups
             FROM outc JOIN grp USING (strategy) GROUP BY 1""",
    ),
)
def a37_variant_summary(spark, sf):
    rows = labelled(spark, sf)
    sig = x2_rule_signals(spark, sf)
    groups = outcomes.dependency_groups(sig, ["strategy"], at="detected_at", ident="signal_id", window=86400)
    counts = groups.groupBy("strategy").agg(F.count_if("group_start").alias("independent_groups"))
    base = rows.groupBy("strategy").agg(
        F.count_distinct("signal_id").alias("signals"), F.min("detected_at").alias("first_signal"), F.max("detected_at").alias("last_signal"),
        F.count_if(F.col("outcome") == "WIN").alias("win"), F.count_if(F.col("outcome") == "LOSS").alias("loss"),
        F.round(F.sum("net"), 6).alias("net_result"),
    )
    return base.join(counts, "strategy")


@query(
    "w11_dependency_groups",
    """WITH RECURSIVE so AS (SELECT event_type AS instrument, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
       fold AS (SELECT instrument, rn, event_id, ts AS anchor, true AS group_start FROM so WHERE rn = 1
         UNION ALL SELECT s.instrument, s.rn, s.event_id, CASE WHEN epoch_us(s.ts) - epoch_us(f.anchor) > 7200000000 THEN s.ts ELSE f.anchor END,
           epoch_us(s.ts) - epoch_us(f.anchor) > 7200000000 FROM fold f JOIN so s ON s.instrument = f.instrument AND s.rn = f.rn + 1)
       SELECT instrument, event_id AS seq, group_start FROM fold""",
)
def w11_dependency_groups(spark, sf):
    return outcomes.dependency_groups(I.ticks(spark, sf), ["instrument"], at="event_time", ident="seq", window=7200)


@query(
    "x13_position_book",
    with_ctes(
        *LABELLED,
        """o4 AS (SELECT *, coalesce(entry_use_time, detected_at) AS st, row_number() OVER (PARTITION BY strategy, horizon ORDER BY coalesce(entry_use_time, detected_at), simulation_id) AS rn FROM outc),
           bk AS (SELECT strategy, horizon, 0::BIGINT AS rn, []::TIMESTAMP[] AS live, NULL::BOOLEAN AS accepted, NULL::VARCHAR AS simulation_id FROM (SELECT DISTINCT strategy, horizon FROM o4)
             UNION ALL SELECT o.strategy, o.horizon, o.rn, CASE WHEN o.entry_price IS NOT NULL AND len(l.kept) < 2 THEN list_append(l.kept, o.expiry) ELSE l.kept END,
               o.entry_price IS NULL OR len(l.kept) < 2, o.simulation_id
             FROM bk b JOIN o4 o ON o.strategy = b.strategy AND o.horizon = b.horizon AND o.rn = b.rn + 1, LATERAL (SELECT list_filter(b.live, lambda e: e > o.st) AS kept) l),
           tk AS (SELECT o4.strategy, o4.horizon, o4.net, o4.simulation_id, o4.detected_at, coalesce(expiry, detected_at) AS due FROM o4 JOIN bk USING (strategy, horizon, simulation_id) WHERE accepted AND net IS NOT NULL),
           cum AS (SELECT *, sum(net) OVER (PARTITION BY strategy, horizon ORDER BY due, detected_at, simulation_id) AS eq FROM tk),
           pk AS (SELECT strategy, horizon, greatest(max(eq) OVER (PARTITION BY strategy, horizon ORDER BY due, detected_at, simulation_id), 0) - eq AS dd FROM cum),
           mdd AS (SELECT strategy, horizon, max(dd) AS dd FROM pk GROUP BY 1, 2)""",
        select="""SELECT b.strategy, b.horizon, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS skipped, round(coalesce(sum(CASE WHEN accepted THEN o4.net END), 0), 6) AS balance,
            round(any_value(mdd.dd), 6) AS max_drawdown FROM bk b JOIN o4 USING (strategy, horizon, simulation_id) LEFT JOIN mdd ON mdd.strategy = b.strategy AND mdd.horizon = b.horizon GROUP BY 1, 2""",
    ),
)
def x13_position_book(spark, sf):
    booked = outcomes.position_book(labelled(spark, sf), ["strategy", "horizon"], max_positions=2)
    out = outcomes.book_summary(pin(booked), ["strategy", "horizon"])
    return out.select("strategy", "horizon", "accepted", "skipped", rnd("balance"), rnd("max_drawdown"))


@query(
    "f1_variant_filters",
    with_ctes(
        *LABELLED,
        """v AS (SELECT 'all' AS variant, * FROM outc UNION ALL SELECT 'longs', * FROM outc WHERE direction = 'UP' UNION ALL SELECT 'asia', * FROM outc WHERE hour(detected_at) < 7)""",
        select="SELECT variant, count(*) AS sample, count(*) FILTER (outcome = 'WIN') AS win, round(coalesce(sum(net), 0), 6) AS net_result FROM v GROUP BY 1",
    ),
)
def f1_variant_filters(spark, sf):
    from tickloom.functions.columns import session_label
    from tickloom.plugins import run_variants

    variants = {
        "all": None, "longs": F.col("direction") == "UP",
        "asia": lambda df: df.where(session_label("detected_at") == "ASIA"),
    }
    rows = run_variants(labelled(spark, sf), variants)
    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("sample"), F.count_if(F.col("outcome") == "WIN").alias("win"),
        F.round(F.coalesce(F.sum("net"), F.lit(0.0)), 6).alias("net_result"),
    )


@query(
    "f2_custom_strategy",
    with_ctes(
        *BASE,
        select="""SELECT instrument, CASE WHEN close > open THEN 'UP' ELSE 'DOWN' END AS direction, available_at AS detected_at FROM bars WHERE valid AND abs(close - open) > 50""",
    ),
)
def f2_custom_strategy(spark, sf):
    from tickloom.plugins import evaluate_strategies

    class WideBody:
        """Bars whose body is wider than a fixed amount."""

        name = "wide_body"
        warmup_bars = 1

        def signals(self, bars):
            df = bars["H4"]
            body = F.col("close") - F.col("open")
            flag = F.when(B.is_valid_bar() & (F.abs(body) > 50), F.when(body > 0, "UP").otherwise("DOWN"))
            return df.withColumn("direction", flag)

    found = evaluate_strategies([WideBody()], {"H4": I.bars(spark, sf)})
    return found.select("instrument", "direction", "detected_at")
