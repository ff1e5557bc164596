"""Queries over indicators, features and rule signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import indicators as N
from tickloom.operators import signals as G
from tickloom.operators import trend as X
from tickloom.operators.asof import latest_known
from tickloom.plans import inputs as I
from tickloom.plans.inputs import SQL, sql_bars, with_ctes
from tickloom.plans.registry import query, rnd
from tickloom.session import pin

H4 = 4 * 3600
SHORT = N.Periods(5, 13, 7, 7)


def sql_indicators(p: N.Periods, bars: str = "bars", name: str = "points") -> str:
    """Literal recursion over the bars of each instrument."""
    af, as_ = 1 - 2 / (p.ema_fast + 1), 1 - 2 / (p.ema_slow + 1)

    def ema(n: int, a: float, s: str, y: str) -> str:
        return f"""CASE WHEN NOT r.eligible OR r.k < {n} THEN NULL WHEN r.k = {n} THEN ({s} + r.close) / {n}
                   ELSE {a!r} * {y} + {1 - a!r} * r.close END"""

    def wilder(n: int, s: str, y: str, x: str, first: int) -> str:
        return f"""CASE WHEN NOT r.eligible OR r.k < {n + first} THEN NULL WHEN r.k = {n + first} THEN ({s} + {x}) / {n}
                   ELSE ({y} * {n - 1} + {x}) / {n} END"""

    up, down = "greatest(r.close - p.pc, 0)", "greatest(p.pc - r.close, 0)"
    tr = "CASE WHEN r.k = 1 THEN r.high - r.low ELSE greatest(r.high - r.low, abs(r.high - p.pc), abs(r.low - p.pc)) END"

    def total(x: str, s: str, first: int = 0) -> str:
        return f"CASE WHEN NOT r.eligible OR r.k <= {first} THEN 0.0 WHEN r.k = {first + 1} THEN {x} ELSE {s} + {x} END"

    return f"""{name}_e AS (
  SELECT *, row_number() OVER w AS rn, lag("end") OVER w AS prev_end, lag(closed) OVER w AS prev_closed
  FROM {bars} WINDOW w AS (PARTITION BY instrument ORDER BY start)),
{name}_f AS (
  SELECT *, closed AND valid AND (NOT coalesce(prev_closed, false) OR start = prev_end) AS eligible FROM {name}_e),
{name}_g AS (
  SELECT *, sum(CASE WHEN eligible THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY start) AS segment FROM {name}_f),
{name}_k AS (
  SELECT *, sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, segment ORDER BY start) AS k FROM {name}_g),
{name}_r AS (
  SELECT instrument, 0::BIGINT AS rn, NULL::DOUBLE AS pc, 0.0::DOUBLE AS sf, NULL::DOUBLE AS ef, NULL::DOUBLE AS es,
         0.0::DOUBLE AS sg, 0.0::DOUBLE AS sl, NULL::DOUBLE AS g, NULL::DOUBLE AS l, 0.0::DOUBLE AS st, NULL::DOUBLE AS atr
  FROM (SELECT DISTINCT instrument FROM {name}_k)
  UNION ALL
  SELECT r.instrument, r.rn, CASE WHEN r.eligible THEN r.close END,
         {total("r.close", "p.sf")}, {ema(p.ema_fast, af, "p.sf", "p.ef")}, {ema(p.ema_slow, as_, "p.sf", "p.es")},
         {total(up, "p.sg", 1)}, {total(down, "p.sl", 1)},
         {wilder(p.rsi, "p.sg", "p.g", up, 1)}, {wilder(p.rsi, "p.sl", "p.l", down, 1)},
         {total(tr, "p.st")}, {wilder(p.atr, "p.st", "p.atr", tr, 0)}
  FROM {name}_r p JOIN {name}_k r ON r.instrument = p.instrument AND r.rn = p.rn + 1),
{name}_v AS (
  SELECT k.*, r.ef AS ema_fast, r.es AS ema_slow, r.atr,
         CASE WHEN r.g IS NULL THEN NULL WHEN r.l = 0 AND r.g = 0 THEN 50.0 WHEN r.l = 0 THEN 100.0
              WHEN r.g = 0 THEN 0.0 ELSE 100.0 - 100.0 / (1.0 + r.g / r.l) END AS rsi
  FROM {name}_k k JOIN {name}_r r USING (instrument, rn)),
{name} AS (
  SELECT *, ema_fast IS NOT NULL AND ema_slow IS NOT NULL AND rsi IS NOT NULL AND atr IS NOT NULL AS ready FROM {name}_v)"""


BASE = (SQL["quotes"], sql_bars(H4))
POINTS = (*BASE, sql_indicators(N.Periods()))


def points(spark, sf, tf: int | tuple[int, ...] = H4, periods: N.Periods = N.Periods()):
    """Indicator rows as a written table: several rules read them."""
    return pin(N.add_indicators(I.bars(spark, sf, tf), periods))


@query(
    "w1_warmup_segments",
    with_ctes(*POINTS, select="""SELECT instrument, start, eligible, segment::BIGINT AS segment,
        CASE WHEN eligible THEN k END::DOUBLE AS sample FROM points"""),
)
def w1_warmup_segments(spark, sf):
    rows = N.warmup_segments(I.bars(spark, sf, H4))
    return rows.select("instrument", "start", "eligible", "segment", F.col("sample").cast("double").alias("sample"))


@query(
    "w2_ema",
    with_ctes(*POINTS, select="""SELECT instrument, start, round(ema_fast, 6) AS ema_fast,
        round(ema_slow, 6) AS ema_slow FROM points"""),
)
def w2_ema(spark, sf):
    return points(spark, sf).select("instrument", "start", rnd("ema_fast"), rnd("ema_slow"))


@query("w3_rsi", with_ctes(*POINTS, select="SELECT instrument, start, round(rsi, 6) AS rsi FROM points"))
def w3_rsi(spark, sf):
    return points(spark, sf).select("instrument", "start", rnd("rsi"))


@query("w4_atr", with_ctes(*POINTS, select="SELECT instrument, start, round(atr, 6) AS atr, ready FROM points"))
def w4_atr(spark, sf):
    return points(spark, sf).select("instrument", "start", rnd("atr"), "ready")


@query(
    "w5_feature_rows",
    with_ctes(
        *POINTS,
        """thr_rows AS (SELECT instrument, atr / abs(close) AS ratio FROM points
            WHERE valid AND close <> 0 AND atr IS NOT NULL AND start < TIMESTAMP '2024-01-20'),
           thr AS (SELECT instrument, ratio AS threshold FROM (
             SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ratio) - 1 AS i,
                    count(*) OVER (PARTITION BY instrument) AS n FROM thr_rows) WHERE i = floor(0.5 * (n - 1))),
           lagged AS (SELECT *, lag("end") OVER w AS pend, lag(available_at) OVER w AS pav, lag(valid) OVER w AS pvalid,
             lag(ema_fast) OVER w AS pef FROM points WINDOW w AS (PARTITION BY instrument ORDER BY start)),
           feat AS (SELECT l.*, CASE WHEN valid AND close <> 0 THEN atr / abs(close) END AS atr_relative,
             CASE WHEN pend = start AND pav <= available_at AND valid AND pvalid AND atr > 0 THEN (ema_fast - pef) / atr END AS ema_slope,
             (SELECT max((q.event_time, q.available_at, q.seq, q.ask - q.bid)) FROM quotes q WHERE q.instrument = l.instrument
               AND q.event_time <= l.available_at AND q.available_at <= l.available_at) AS best FROM lagged l)""",
        select="""SELECT f.instrument, start, round(atr_relative, 6) AS atr_relative, round(ema_slope, 6) AS ema_slope,
            round(CASE WHEN atr > 0 THEN best[4] / atr END, 6) AS spread_atr,
            CASE WHEN hour("end") < 7 THEN 'ASIA' WHEN hour("end") < 12 THEN 'LONDON' WHEN hour("end") < 17 THEN 'NEW_YORK'
                 WHEN hour("end") < 22 THEN 'NY_LATE' ELSE 'OFF' END AS session,
            CASE WHEN atr_relative IS NULL OR threshold IS NULL THEN NULL WHEN atr_relative < threshold THEN 'LOW' ELSE 'HIGH' END AS regime
            FROM feat f LEFT JOIN thr USING (instrument)""",
    ),
)
def w5_feature_rows(spark, sf):
    feats = N.add_features(points(spark, sf))
    limits = N.volatility_threshold(feats, F.col("start") < "2024-01-20", 0.5, ["instrument"])
    quotes = I.quotes(spark, sf).withColumn("spread", F.col("ask") - F.col("bid"))
    rows = latest_known(
        feats.drop("quality_flags"), quotes, left_id=["start"], right_id=["seq"], values=["spread"]
    ).join(limits, "instrument", "left")
    return rows.select(
        "instrument", "start", rnd("atr_relative"), rnd("ema_slope"),
        F.round(F.when(F.col("atr") > 0, F.col("q_spread") / F.col("atr")), 6).alias("spread_atr"), "session",
        N.volatility_regime(F.col("atr_relative"), F.col("threshold")).alias("regime"),
    )


@query(
    "w6_donchian_breakout",
    with_ctes(
        *BASE,
        """ch AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS upper, min(low) OVER w AS lower,
             bool_and(closed AND valid) OVER w AS all_ok, max(available_at) OVER w AS known FROM bars
             WINDOW w AS (PARTITION BY instrument ORDER BY start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
           rs AS (SELECT *, CASE WHEN NOT (closed AND valid) THEN 'bar_not_available' WHEN n < 20 THEN 'warmup_pending'
             WHEN NOT all_ok THEN 'lookback_not_available' WHEN known > available_at THEN 'lookback_future_data'
             WHEN hour("end") >= 22 THEN 'session_filter_failed'
             WHEN close <= upper AND close >= lower THEN 'channel_breakout_absent' END AS reason FROM ch)""",
        select="""SELECT instrument, start, round(upper, 6) AS channel_upper, round(lower, 6) AS channel_lower, reason,
            CASE WHEN reason IS NULL THEN CASE WHEN close > upper THEN 'UP' ELSE 'DOWN' END END AS direction,
            CASE WHEN reason IS NULL THEN 'signal' WHEN reason = 'warmup_pending' THEN 'wait'
                 WHEN reason IN ('session_filter_failed', 'channel_breakout_absent') THEN 'discarded' ELSE 'blocked' END AS decision
            FROM rs""",
    ),
)
def w6_donchian_breakout(spark, sf):
    rows = G.donchian(I.bars(spark, sf, H4), 20, ("ASIA", "LONDON", "NEW_YORK", "NY_LATE"))
    return rows.select(
        "instrument", "start", rnd("channel_upper"), rnd("channel_lower"), "reason", "direction", "decision"
    )


CROSS = """crossed AS (SELECT *, CASE
    WHEN ready AND pready AND pc <= pe AND close > ema_fast AND rsi > 50 THEN 'UP'
    WHEN ready AND pready AND pc >= pe AND close < ema_fast AND rsi < 50 THEN 'DOWN' END AS direction FROM (
    SELECT *, lag(ready) OVER w AS pready, lag(close) OVER w AS pc, lag(ema_fast) OVER w AS pe FROM points
    WINDOW w AS (PARTITION BY instrument ORDER BY start)))"""


@query(
    "w7_ema_cross",
    with_ctes(*POINTS, CROSS, select="SELECT instrument, start, close, direction FROM crossed WHERE direction IS NOT NULL"),
)
def w7_ema_cross(spark, sf):
    rows = G.ema_cross(points(spark, sf)).where(F.col("direction").isNotNull())
    return rows.select("instrument", "start", "close", "direction")


@query(
    "w8_context_direction",
    with_ctes(
        *POINTS,
        """ctx AS (SELECT *, lag(ema_slow, 3) OVER w AS lag_slow, lag(valid, 3) OVER w AS lag_ok FROM points
             WINDOW w AS (PARTITION BY instrument ORDER BY start))""",
        select="""SELECT instrument, start,
            coalesce(valid AND lag_ok AND lag_slow IS NOT NULL AND ema_fast IS NOT NULL AND ema_slow IS NOT NULL, false) AS context_known,
            CASE WHEN NOT (valid AND lag_ok) THEN NULL WHEN ema_fast > ema_slow AND ema_slow > lag_slow THEN 'UP'
                 WHEN ema_fast < ema_slow AND ema_slow < lag_slow THEN 'DOWN' END AS context_direction FROM ctx""",
    ),
)
def w8_context_direction(spark, sf):
    return G.context_direction(points(spark, sf)).select("instrument", "start", "context_known", "context_direction")


SID = "substr(sha256(concat_ws('|', '{s}', instrument, epoch_us(start)::VARCHAR, direction)), 1, 32)"


@query(
    "x2_rule_signals",
    with_ctes(
        *POINTS, CROSS,
        """ch AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS upper, min(low) OVER w AS lower,
             bool_and(closed AND valid) OVER w AS all_ok, max(available_at) OVER w AS known FROM bars
             WINDOW w AS (PARTITION BY instrument ORDER BY start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
           don AS (SELECT *, CASE WHEN close > upper THEN 'UP' WHEN close < lower THEN 'DOWN' END AS direction FROM ch
             WHERE closed AND valid AND n >= 20 AND all_ok AND known <= available_at)""",
        select=f"""SELECT 'sig_' || {SID.format(s="donchian20")} AS signal_id, instrument, direction,
              available_at AS detected_at, 'donchian20' AS strategy FROM don WHERE direction IS NOT NULL
            UNION ALL SELECT 'sig_' || {SID.format(s="ema_cross")}, instrument, direction, available_at, 'ema_cross'
              FROM crossed WHERE direction IS NOT NULL""",
    ),
)
def x2_rule_signals(spark, sf):
    pts = points(spark, sf)
    both = G.as_signals(G.donchian(pts), "donchian20").unionByName(G.as_signals(G.ema_cross(pts), "ema_cross"))
    return pin(both.select("signal_id", "instrument", "direction", "detected_at", "strategy"))


@query(
    "a34_volatility_threshold",
    with_ctes(
        *POINTS,
        """thr_rows AS (SELECT instrument, atr / abs(close) AS ratio FROM points
            WHERE valid AND close <> 0 AND atr IS NOT NULL AND start < TIMESTAMP '2024-01-20')""",
        select="""SELECT instrument, round(ratio, 6) AS threshold, n AS sample_count FROM (
             SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ratio) - 1 AS i,
                    count(*) OVER (PARTITION BY instrument) AS n FROM thr_rows) WHERE i = floor(0.7 * (n - 1))""",
    ),
)
def a34_volatility_threshold(spark, sf):
    out = N.volatility_threshold(points(spark, sf), F.col("start") < "2024-01-20", 0.7, ["instrument"])
    return out.select("instrument", rnd("threshold"), "sample_count")


def trend_inputs(spark, sf):
    sizes = (12 * 3600, 8 * 3600, H4)
    table = points(spark, sf, sizes, SHORT)
    return {tf: table.where(F.col("tf_seconds") == tf) for tf in sizes}


def trend_evaluations(spark, sf):
    p = trend_inputs(spark, sf)
    return X.evaluate(p[12 * 3600], p[8 * 3600], p[H4], preparation_seconds=8 * 3600)


TREND_INPUT = (
    SQL["quotes"],
    sql_bars(12 * 3600, "b12"), sql_indicators(SHORT, "b12", "p12"), sql_bars(8 * 3600, "b8"), sql_indicators(SHORT, "b8", "p8"),
    sql_bars(H4, "b4"), sql_indicators(SHORT, "b4", "p4"),
)

# A literal fold over the merged stream: one state per instrument, one row at a time.
TREND_FOLD = """c AS (SELECT instrument, start, "end", valid AS ok, ema_fast, ema_slow, lag(ema_slow, 3) OVER w AS slag, lag(valid, 3) OVER w AS lok,
    greatest(available_at, lag(available_at, 3) OVER w) AS known_at FROM p12 WINDOW w AS (PARTITION BY instrument ORDER BY start)),
  ck AS (SELECT *, coalesce(ok AND lok AND slag IS NOT NULL AND ema_fast IS NOT NULL AND ema_slow IS NOT NULL, false) AS known FROM c),
  mrg AS (
    SELECT instrument, known_at, 0 AS stage, start, "end", NULL::DOUBLE AS close, NULL::DOUBLE AS ema, NULL::DOUBLE AS atr, NULL::DOUBLE AS rsi, false AS ok,
      NULL::DOUBLE AS cl, false AS lok, NULL::DOUBLE AS pc, NULL::DOUBLE AS pe, NULL::TIMESTAMP AS pend, false AS pok,
      CASE WHEN known AND ema_fast > ema_slow AND ema_slow > slag THEN 'UP' WHEN known AND ema_fast < ema_slow AND ema_slow < slag THEN 'DOWN' END AS cdir, known AS cknown FROM ck
    UNION ALL SELECT instrument, greatest(available_at, lag(available_at, 3) OVER w), 1, start, "end", close, ema_fast, atr, NULL, valid, lag(close, 3) OVER w, coalesce(lag(valid, 3) OVER w, false),
      NULL, NULL, NULL, false, NULL, false FROM p8 WINDOW w AS (PARTITION BY instrument ORDER BY start)
    UNION ALL SELECT instrument, available_at, 2, start, "end", close, ema_fast, NULL, rsi, valid, NULL, false, lag(close) OVER w, lag(ema_fast) OVER w, lag("end") OVER w,
      coalesce(lag(valid) OVER w, false), NULL, false FROM p4 WINDOW w AS (PARTITION BY instrument ORDER BY start)),
  num AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY known_at, stage, start) AS rn FROM mrg),
  fold AS (
    SELECT instrument, 0::BIGINT AS rn, -1 AS stage, NULL::TIMESTAMP AS start, NULL::TIMESTAMP AS known_at, NULL::VARCHAR AS cdir, false AS cknown, NULL::TIMESTAMP AS es, NULL::VARCHAR AS ed,
      NULL::TIMESTAMP AS ex, false AS used, false AS live, '' AS decision, NULL::VARCHAR AS direction, NULL::TIMESTAMP AS episode_start FROM (SELECT DISTINCT instrument FROM num)
    UNION ALL
    SELECT n.instrument, n.rn, n.stage, n.start, n.known_at,
      CASE WHEN n.stage = 0 THEN n.cdir ELSE f.cdir END, CASE WHEN n.stage = 0 THEN n.cknown ELSE f.cknown END,
      CASE WHEN d.dec = 'preparation' THEN n.start ELSE f.es END, CASE WHEN d.dec = 'preparation' THEN f.cdir ELSE f.ed END,
      CASE WHEN d.dec = 'preparation' THEN n.known_at + INTERVAL 24 HOUR ELSE f.ex END,
      CASE WHEN d.dec = 'preparation' THEN false WHEN d.dec = 'signal' THEN true ELSE f.used END,
      CASE WHEN d.dec = 'preparation' THEN true WHEN n.stage = 0 THEN f.live AND n.cknown AND coalesce(n.cdir = f.ed, false) WHEN n.stage = 2 THEN t.alive ELSE f.live END,
      coalesce(d.dec, ''), CASE WHEN n.stage = 2 THEN t.dir ELSE f.cdir END,
      CASE WHEN d.dec = 'preparation' THEN n.start WHEN n.stage = 2 AND t.alive THEN f.es END
    FROM fold f JOIN num n ON n.instrument = f.instrument AND n.rn = f.rn + 1,
    LATERAL (SELECT f.live AND n.known_at < f.ex AS alive, f.live AND n.known_at >= f.ex AS expired,
      CASE WHEN f.live AND n.known_at < f.ex THEN f.ed ELSE f.cdir END AS dir) t,
    LATERAL (SELECT
      CASE WHEN f.cdir IS NOT NULL THEN 'F' WHEN f.cknown THEN 'X' ELSE 'U' END AS p1,
      CASE WHEN NOT (n.ok AND n.lok AND n.cl IS NOT NULL) THEN 'U' WHEN (f.cdir = 'UP' AND n.close < n.cl) OR (f.cdir = 'DOWN' AND n.close > n.cl) THEN 'F' ELSE 'X' END AS p2,
      CASE WHEN NOT (n.ok AND n.lok AND n.cl IS NOT NULL) OR n.ema IS NULL OR n.atr IS NULL THEN 'U' WHEN abs(n.close - n.ema) <= 0.5 * n.atr THEN 'F' ELSE 'X' END AS p3,
      CASE WHEN n.ok THEN 'F' ELSE 'U' END AS q,
      CASE WHEN t.dir IS NOT NULL AND coalesce(f.cdir = t.dir, false) THEN 'F' WHEN NOT f.cknown THEN 'U' ELSE 'X' END AS t1,
      CASE WHEN t.alive AND NOT f.used THEN 'F' WHEN t.alive OR t.expired THEN 'X' ELSE 'U' END AS t2,
      CASE WHEN t.dir IS NULL OR NOT n.ok OR n.ema IS NULL OR NOT n.pok OR n.pe IS NULL OR n.pend IS NULL OR n.pend <> n.start THEN 'U'
           WHEN t.dir = 'UP' AND n.pc <= n.pe AND n.close > n.ema OR t.dir = 'DOWN' AND n.pc >= n.pe AND n.close < n.ema THEN 'F' ELSE 'X' END AS t3,
      CASE WHEN t.dir IS NULL OR n.rsi IS NULL OR NOT n.ok THEN 'U' WHEN t.dir = 'UP' AND n.rsi > 50 OR t.dir = 'DOWN' AND n.rsi < 50 THEN 'F' ELSE 'X' END AS t4) s,
    LATERAL (SELECT CASE WHEN n.stage = 1 THEN CASE WHEN 'U' IN (p1, p2, p3, q) THEN 'blocked' WHEN 'X' IN (p1, p2, p3, q) THEN 'discarded' ELSE 'preparation' END
      WHEN n.stage = 2 THEN CASE WHEN t.expired OR (t.alive AND f.used) OR t1 = 'X' OR 'U' IN (t1, t2, t3, t4, q) THEN 'blocked' WHEN 'X' IN (t1, t2, t3, t4, q) THEN 'discarded' ELSE 'signal' END END AS dec) d)"""


@query(
    "x1_trend_pullback",
    with_ctes(
        *TREND_INPUT, TREND_FOLD,
        select="""SELECT instrument, CASE stage WHEN 1 THEN 'preparation' ELSE 'trigger' END AS stage, start, known_at AS available_at, direction, decision, episode_start FROM fold WHERE stage > 0""",
    ),
)
def x1_trend_pullback(spark, sf):
    return trend_evaluations(spark, sf).select(
        "instrument", "stage", "start", "available_at", "direction", "decision", "episode_start"
    )


@query("x1_condition_reasons")
def x1_condition_reasons(spark, sf):
    rows = trend_evaluations(spark, sf).select("stage", F.explode("conditions").alias("c"))
    return rows.groupBy("stage", "c.name", "c.state", "c.reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x3_detector_signals",
    with_ctes(
        *TREND_INPUT, TREND_FOLD,
        select="""SELECT 'sig_' || substr(sha256(concat_ws('|', 'trend_pullback', instrument, epoch_us(episode_start)::VARCHAR, epoch_us(start)::VARCHAR)), 1, 32) AS signal_id,
            instrument, direction, known_at AS detected_at, 'trend_pullback' AS strategy, start, episode_start FROM fold WHERE decision = 'signal'""",
    ),
)
def x3_detector_signals(spark, sf):
    return X.signals(trend_evaluations(spark, sf)).drop("context_start")
