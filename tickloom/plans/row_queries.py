"""Queries over predicates, projections, duplicates, order and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.functions import columns as C
from tickloom.functions import identity, quality, trade
from tickloom.operators import bars as B
from tickloom.operators import dedupe
from tickloom.plans import inputs as I
from tickloom.plans.inputs import SQL, sql_bars, sql_strict_bars, with_ctes
from tickloom.plans.registry import query, rnd, text_list


def mixed_base(spark, sf):
    """Quotes whose price base rotates; every 11th lacks its ask."""
    q = I.quotes(spark, sf)
    n = F.col("seq") % 5
    base = F.when(n == 0, "trade").when(n == 1, "Bid").when(n == 2, "ask").when(n == 3, "mid").otherwise("bogus")
    return q.withColumns({
        "price": F.col("bid") + 0.005, "price_base": base, "ask": F.when(F.col("seq") % 11 != 0, F.col("ask")),
    })


@query(
    "p1_selected_price",
    with_ctes(
        SQL["quotes"],
        """m AS (SELECT seq, bid, bid + 0.005::DOUBLE AS price, CASE WHEN seq % 11 <> 0 THEN ask END AS ask FROM quotes)""",
        select="""SELECT seq, round(CASE seq % 5 WHEN 0 THEN price WHEN 1 THEN bid WHEN 2 THEN ask WHEN 3 THEN (bid + ask) / 2 END, 6)
                  AS selected_price FROM m""",
    ),
)
def p1_selected_price(spark, sf):
    return mixed_base(spark, sf).select("seq", F.round(C.selected_price(), 6).alias("selected_price"))


@query(
    "p2_effective_availability",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 9 SECOND END,
         CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 4 SECOND END, ts) AS effective, event_id % 3 = 0 AS availability_known FROM events""",
)
def p2_effective_availability(spark, sf):
    e = I.table(spark, sf, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    rows = e.withColumns({
        "available_at": F.when(F.col("event_id") % 3 == 0, F.col("event_time") + F.expr("INTERVAL 9 SECONDS")),
        "received_at": F.when(F.col("event_id") % 2 == 0, F.col("event_time") + F.expr("INTERVAL 4 SECONDS")),
    })
    return rows.select(
        "event_id", C.effective_available().alias("effective"), F.col("available_at").isNotNull().alias("availability_known")
    )


@query(
    "p3_interval_start",
    """SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS m5,
       time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS h4, epoch_us(ts) // 300000000 AS ordinal FROM events""",
)
def p3_interval_start(spark, sf):
    t = I.ticks(spark, sf)
    return t.select(
        F.col("seq").alias("event_id"), C.interval_start("event_time", C.timeframe_seconds("M5")).alias("m5"),
        C.interval_start("event_time", C.timeframe_seconds("4H")).alias("h4"),
        C.interval_ordinal("event_time", 300).alias("ordinal"),
    )


def spoiled_ticks(spark, sf):
    t, n = I.ticks(spark, sf), F.col("seq")
    return t.withColumns({
        "instrument": F.when(n % 101 == 0, " ").otherwise(F.col("instrument")),
        "price": F.when(n % 97 == 0, float("nan")).when(n % 89 == 0, None).otherwise(F.col("price")),
        "quantity": F.when(n % 83 == 0, -1.0).otherwise(F.col("quantity")),
        "available_at": F.when(n % 79 == 0, F.col("event_time") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("available_at")),
        "received_at": F.when(n % 73 == 0, F.col("event_time") - F.expr("INTERVAL 1 SECOND")),
        "quality_flags": F.when(n % 71 == 0, F.array(F.lit("stale"), F.lit("synthetic")))
        .when(n % 67 == 0, F.array(F.lit("synthetic"))).otherwise(F.col("quality_flags")),
    })


@query(
    "p4_tick_validation",
    """SELECT event_id AS seq, concat_ws(',', CASE WHEN event_id % 101 = 0 THEN 'instrument_missing' END,
         CASE WHEN event_id % 97 = 0 THEN 'non_finite' END,
         CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN 'price_base_missing' END,
         CASE WHEN event_id % 83 = 0 THEN 'quantity_negative' END,
         CASE WHEN event_id % 71 = 0 THEN 'quality_blocked' END) AS issues FROM events""",
)
def p4_tick_validation(spark, sf):
    clocks = {"received_before_event", "available_before_event"}
    rows = quality.validate_ticks(spoiled_ticks(spark, sf))
    return rows.select("seq", F.concat_ws(",", F.array_except("issues", F.array(*map(F.lit, sorted(clocks))))).alias("issues"))


@query(
    "p5_tick_clock_rules",
    """SELECT event_id AS seq, event_id % 73 = 0 AS received_early, event_id % 79 = 0 AS available_early FROM events""",
)
def p5_tick_clock_rules(spark, sf):
    rows = quality.validate_ticks(spoiled_ticks(spark, sf))
    has = lambda code: F.array_contains("issues", code)
    return rows.select(
        "seq", has("received_before_event").alias("received_early"), has("available_before_event").alias("available_early")
    )


@query(
    "p6_bar_validation",
    with_ctes(
        SQL["ticks"], sql_strict_bars(3600),
        """s AS (SELECT instrument, start, closed, partial, event_count,
             CASE WHEN event_count = 2 THEN low - 1 ELSE high END AS high, open, close, low,
             CASE WHEN event_count = 5 THEN -volume ELSE volume END AS volume,
             CASE WHEN event_count = 4 THEN "end" + INTERVAL 1 MINUTE ELSE "end" END AS "end" FROM bars)""",
        select="""SELECT instrument, start, concat_ws(',', CASE WHEN event_count = 4 THEN 'timeframe_mismatch' END,
              CASE WHEN event_count <> 4 AND high < greatest(open, close, low) OR event_count <> 4 AND low > least(open, close, high) THEN 'ohlc_incoherent' END,
              CASE WHEN event_count = 5 THEN 'negative_measure' END, CASE WHEN NOT closed THEN 'candle_open' END,
              CASE WHEN partial THEN 'quality_blocked' END) AS issues FROM s""",
    ),
)
def p6_bar_validation(spark, sf):
    b, n = I.strict_bars(spark, sf), F.col("event_count")
    spoiled = b.withColumns({
        "high": F.when(n == 2, F.col("low") - 1).otherwise(F.col("high")),
        "volume": F.when(n == 5, -F.col("volume")).otherwise(F.col("volume")),
        "end": F.when(n == 4, F.col("end") + F.expr("INTERVAL 1 MINUTE")).otherwise(F.col("end")),
    })
    return quality.validate_bars(spoiled, require_closed=True).select("instrument", "start", text_list("issues"))


FLAG_SETS = (("valid",), ("stale", "synthetic"), ("gap", "partial"), ("synthetic",), ("duplicate", "invalid"), ("late", "open"))
SQL_STATUS = "CASE seq % 6 WHEN 1 THEN 'stale' WHEN 2 THEN 'gap' WHEN 3 THEN 'synthetic' WHEN 4 THEN 'invalid' WHEN 5 THEN 'open' ELSE 'valid' END"


def flagged(spark, sf):
    t = I.ticks(spark, sf)
    sets = F.array(*[F.array(*map(F.lit, s)) for s in FLAG_SETS])
    return t.withColumn("quality_flags", F.element_at(sets, (F.col("seq") % 6 + 1).cast("int")))


@query(
    "p7_quality_status",
    with_ctes(SQL["ticks"], select=f"SELECT seq, {SQL_STATUS} AS status, seq % 6 IN (0, 3) AS usable FROM ticks"),
)
def p7_quality_status(spark, sf):
    return flagged(spark, sf).select(
        "seq", quality.status("quality_flags").alias("status"), (~quality.is_blocked("quality_flags")).alias("usable")
    )


@query(
    "p8_quality_merge",
    with_ctes(
        SQL["ticks"],
        """f AS (SELECT instrument, time_bucket(INTERVAL 1 HOUR, event_time, TIMESTAMP '1970-01-01') AS start, unnest(CASE seq % 6
             WHEN 0 THEN ['valid'] WHEN 1 THEN ['stale', 'synthetic'] WHEN 2 THEN ['gap', 'partial'] WHEN 3 THEN ['synthetic']
             WHEN 4 THEN ['duplicate', 'invalid'] ELSE ['late', 'open'] END) AS flag FROM ticks)""",
        select="SELECT instrument, start, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM f GROUP BY ALL",
    ),
)
def p8_quality_merge(spark, sf):
    return flagged(spark, sf).groupBy("instrument", C.interval_start("event_time", 3600).alias("start")).agg(
        F.concat_ws(",", quality.merged_flags("quality_flags")).alias("flags")
    )


@query(
    "p9_freshness",
    with_ctes(
        SQL["ticks"], sql_strict_bars(3600),
        """now AS (SELECT max(available_at) + INTERVAL 90 SECOND AS now FROM bars),
           l AS (SELECT instrument, max(available_at) AS r, max(CASE WHEN closed THEN "end" END) AS c FROM bars GROUP BY 1)""",
        select="""SELECT instrument, round((epoch_us(now) - epoch_us(r)) / 1e6, 3) AS feed_age, round((epoch_us(now) - epoch_us(c)) / 1e6, 3) AS bar_age,
            CASE WHEN (epoch_us(now) - epoch_us(r)) / 1e6 > 600 THEN 'stale' WHEN (epoch_us(now) - epoch_us(c)) / 1e6 > 3600 THEN 'late' ELSE 'valid' END AS state
            FROM l, now""",
    ),
)
def p9_freshness(spark, sf):
    b = I.strict_bars(spark, sf)
    now = b.agg(F.max("available_at").alias("t")).select(C.plus_seconds("t", 90)).scalar()
    out = quality.freshness(
        b.withColumn("now", now), "now", keys=["instrument", "now"], received="available_at", bar_end="end",
        closed="closed", max_feed_age=600, max_bar_age=3600,
    )
    return out.select("instrument", rnd("feed_age", 3), rnd("bar_age", 3), "state")


@query(
    "p10_session_label",
    """SELECT event_id AS seq, CASE WHEN hour(ts) < 7 THEN 'ASIA' WHEN hour(ts) < 12 THEN 'LONDON' WHEN hour(ts) < 17 THEN 'NEW_YORK'
       WHEN hour(ts) < 22 THEN 'NY_LATE' ELSE 'OFF' END AS session FROM events""",
)
def p10_session_label(spark, sf):
    return I.ticks(spark, sf).select("seq", C.session_label("event_time").alias("session"))


@query("p11_hour_blocks", "SELECT hour(ts) AS hour, hour(ts) // 8 AS block, count(*) AS ticks FROM events GROUP BY ALL")
def p11_hour_blocks(spark, sf):
    t = I.ticks(spark, sf)
    return t.groupBy(F.hour("event_time").cast("bigint").alias("hour"), C.hour_block("event_time").alias("block")).agg(
        F.count(F.lit(1)).alias("ticks")
    )


@query(
    "p12_open_seconds",
    """WITH p AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + to_hours(o_orderkey % 700) AS e FROM orders),
       fri AS (SELECT DATE '1994-12-30' + 7 * i::INT AS d FROM range(400) t(i)),
       c AS (SELECT timezone('UTC', timezone('America/New_York', d + INTERVAL 17 HOUR)) AS cs,
                    timezone('UTC', timezone('America/New_York', d + INTERVAL 2 DAY + INTERVAL 17 HOUR)) AS ce FROM fri),
       x AS (SELECT o_orderkey, s, e, coalesce(sum(CASE WHEN cs IS NOT NULL THEN greatest(0, least(epoch_us(e), epoch_us(ce)) - greatest(epoch_us(s), epoch_us(cs))) END), 0) / 1e6 AS closed
             FROM p LEFT JOIN c ON cs < e AND ce > s GROUP BY 1, 2, 3)
       SELECT o_orderkey, (epoch_us(e) - epoch_us(s)) / 1e6 - closed AS open_seconds,
              e > s AND (epoch_us(e) - epoch_us(s)) / 1e6 - closed = 0 AS covers_closed FROM x""",
)
def p12_open_seconds(spark, sf):
    o = I.table(spark, sf, "orders").withColumn("s", F.col("o_orderdate").cast("timestamp"))
    o = o.withColumn("e", C.plus_seconds("s", (F.col("o_orderkey") % 700) * 3600))
    return o.select(
        "o_orderkey", cal.open_seconds("s", "e").alias("open_seconds"), cal.covers_closed("s", "e").alias("covers_closed")
    )


@query(
    "p13_entry_gate",
    """WITH l AS (SELECT event_id AS seq, timezone('America/New_York', timezone('UTC', ts)) AS t FROM events),
       d AS (SELECT seq, t, isodow(t) - 1 AS dow, epoch_us(t) % 86400000000 / 1e6 AS sec FROM l)
       SELECT seq, CASE
         WHEN dow = 5 OR (dow = 6 AND sec < 61260) OR (dow = 4 AND sec >= 60900) THEN 'WEEKEND_CLOSED'
         WHEN sec >= 61140 AND sec < 61260 THEN 'DAILY_BREAK'
         WHEN dow = 4 AND 60900 - sec BETWEEN 0 AND 1800 THEN 'PRE_WEEKLY_CLOSE'
         WHEN dow < 5 AND 61200 - sec BETWEEN 0 AND 1800 AND sec < 61200 THEN 'PRE_FINANCING'
         WHEN 61140 - sec BETWEEN 0 AND 1800 AND sec < 61140 THEN 'PRE_DAILY_BREAK' END AS gate FROM d""",
)
def p13_entry_gate(spark, sf):
    return I.ticks(spark, sf).select("seq", cal.entry_gate("event_time").alias("gate"))


WEEKLY_OPEN = [(61200 + 86400 * d, 61200 + 86400 * (d + 1) - 120) for d in range(5)]
HOLIDAYS = [("2024-01-01 00:00:00", "2024-01-02 00:00:00"), ("2024-01-15 12:00:00", "2024-01-15 18:00:00")]


@query(
    "p14_schedule_window",
    """WITH w AS (SELECT event_id AS seq, ts AS s, ts + to_seconds(event_id % 4000) AS e, event_id % 4000 AS len FROM events),
       l AS (SELECT *, timezone('America/New_York', timezone('UTC', s)) AS t FROM w),
       x AS (SELECT *, (dayofweek(t) * 86400000000 + epoch_us(t) % 86400000000) AS since FROM l),
       iv AS (SELECT (61200 + 86400 * d + k * 604800) * 1000000 AS lo, (61200 + 86400 * (d + 1) - 120 + k * 604800) * 1000000 AS hi FROM range(5) a(d), range(2) b(k)),
       c AS (SELECT seq, s, e, len, sum(greatest(least(since + len * 1000000, hi) - greatest(since, lo), 0)) AS covered FROM x, iv GROUP BY ALL)
       SELECT seq, CASE WHEN len <= 0 OR len > 3600 THEN 'UNKNOWN'
         WHEN s < TIMESTAMP '2024-01-02' AND e > TIMESTAMP '2024-01-01' OR s < TIMESTAMP '2024-01-15 18:00:00' AND e > TIMESTAMP '2024-01-15 12:00:00'
           OR covered < len * 1000000 THEN 'CLOSED_SCHEDULED' ELSE 'OPEN' END AS state FROM c""",
)
def p14_schedule_window(spark, sf):
    t = I.ticks(spark, sf).withColumn("until", C.plus_seconds("event_time", F.col("seq") % 4000))
    return t.select("seq", cal.schedule_state("event_time", "until", WEEKLY_OPEN, HOLIDAYS).alias("state"))


@query(
    "p15_quote_pair_reasons",
    with_ctes(
        SQL["quotes"],
        select="""SELECT seq, array_to_string(list_sort(list_distinct(list_filter([
            CASE WHEN seq % 13 = 0 THEN 'MISSING_ASK' END, CASE WHEN seq % 17 = 0 THEN 'DISCONNECTED' END,
            CASE WHEN seq % 19 = 0 THEN 'SNAPSHOT' END, CASE WHEN seq % 23 = 0 THEN 'OUT_OF_ORDER' END,
            CASE WHEN seq % 29 = 0 THEN 'SESSION_MISMATCH' END,
            CASE WHEN seq % 17 = 0 OR seq % 19 = 0 OR seq % 23 = 0 OR seq % 29 = 0 OR seq % 31 = 0 THEN 'INVALID_QUALITY' END,
            CASE WHEN seq % 37 = 0 THEN 'MISSING_SOURCE_TIMESTAMP' END,
            CASE WHEN seq % 41 = 0 AND seq % 37 <> 0 THEN 'FUTURE_SOURCE_TIMESTAMP' WHEN seq % 37 <> 0 AND seq % 7 > 5 THEN 'FUTURE_AVAILABILITY' END,
            CASE WHEN seq % 7 > 5 THEN 'FUTURE_AVAILABILITY' WHEN seq % 43 = 0 THEN 'STALE' END,
            CASE WHEN seq % 13 <> 0 AND seq % 47 = 0 THEN 'CROSSED' END], lambda x: x IS NOT NULL))), ',') AS reasons FROM quotes""",
    ),
)
def p15_quote_pair_reasons(spark, sf):
    q, n = I.quotes(spark, sf), F.col("seq")
    q = q.withColumns({
        "checked": F.col("event_time") + F.expr("INTERVAL 5 SECONDS"),
        "ask": F.when(n % 13 == 0, None).when(n % 47 == 0, F.col("bid") - 1).otherwise(F.col("ask")),
        "bid_time": F.when(n % 37 == 0, None).when(n % 41 == 0, F.col("event_time") + F.expr("INTERVAL 60 SECONDS"))
        .otherwise(F.col("event_time")),
        "ask_time": F.when(n % 43 == 0, F.col("event_time") - F.expr("INTERVAL 60 SECONDS")).otherwise(F.col("event_time")),
        "session": F.when(n % 29 == 0, 2).otherwise(1), "q": F.when(n % 31 == 0, "stale").otherwise("valid"),
        "connected": n % 17 != 0, "snapshot": n % 19 == 0, "disorder": n % 23 == 0,
    })
    common = dict(
        received_at="received_at", available_at="available_at", session="session", quality="q", checked_at="checked",
        max_age_seconds=30, expected_session=F.lit(1), connected="connected", snapshot="snapshot", out_of_order="disorder",
    )
    q = q.withColumns({
        "_b": quality.leg_reasons("BID", price="bid", source_time="bid_time", **common),
        "_a": quality.leg_reasons("ASK", price="ask", source_time="ask_time", **common),
    })
    pair = quality.pair_reasons("_b", "_a", bid="bid", ask="ask")
    return q.select("seq", F.concat_ws(",", F.array_sort(pair)).alias("reasons"))


@query(
    "p16_quantity_grid",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN l_quantity <= 3 THEN 'outside_range' WHEN l_quantity > 45 THEN 'outside_range'
             WHEN (l_quantity * 100 - 400)::BIGINT % 300 <> 0 THEN 'off_step' END AS open_issue,
        CASE WHEN l_linenumber = 7 THEN 'not_exact' END AS close_issue FROM lineitem""",
)
def p16_quantity_grid(spark, sf):
    li = I.table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,4)"))
    closing = F.when(F.col("l_linenumber") == 7, F.col("q") + F.lit("0.0050").cast("decimal(18,4)")).otherwise(F.col("q"))
    lo, hi, st = (F.lit(v) for v in (400, 4500, 300))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", trade.quantity_issue("q", lo, hi, st).alias("open_issue"),
        trade.quantity_issue(closing, lo, hi, st, opening=False).alias("close_issue"),
    )


@query(
    "p17_scenario_repricing",
    with_ctes(
        SQL["quotes"],
        """sc AS (SELECT * FROM (VALUES ('base', 5, 0.1, 1.0), ('adverse', 10, 0.2, 1.5), ('extreme', 10, 0.2, 2.0)) v(scenario, lat, slip, mult))""",
        select="""SELECT seq, scenario, round((bid + ask) / 2 - (ask - bid) * mult::DOUBLE / 2, 6) AS bid, round((bid + ask) / 2 + (ask - bid) * mult::DOUBLE / 2, 6) AS ask,
             event_time + to_seconds(lat) AS usable_at, slip::DOUBLE AS slippage_pips FROM quotes, sc""",
    ),
)
def p17_scenario_repricing(spark, sf):
    rows = trade.per_scenario(I.quotes(spark, sf))
    bid, ask = trade.widened("bid", "ask", "spread_multiplier")
    return rows.select(
        "seq", "scenario", F.round(bid, 6).alias("bid"), F.round(ask, 6).alias("ask"),
        C.plus_seconds("event_time", F.col("latency_seconds")).alias("usable_at"), "slippage_pips",
    )


@query(
    "p20_redaction",
    """SELECT event_id, '{"token": ***, "k": ' || (props::JSON ->> 'k') || '}' AS payload FROM events""",
)
def p20_redaction(spark, sf):
    e = I.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit('{"token": "'), F.md5("props"), F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("payload"),
        F.lit("x").alias("api_key"),
    )
    return C.redact(e)


@query(
    "p21_boundary_projection",
    with_ctes(
        SQL["quotes"],
        select="""SELECT seq, CASE seq % 5 WHEN 0 THEN 'traded' WHEN 1 THEN 'bid' WHEN 2 THEN 'ask' WHEN 3 THEN 'mid' END AS price_base,
                  CASE WHEN seq % 5 = 4 THEN 'unknown_price_base' END AS quarantine FROM quotes""",
    ),
)
def p21_boundary_projection(spark, sf):
    base = C.normal_price_base("price_base")
    return mixed_base(spark, sf).select(
        "seq", base.alias("price_base"), F.when(base.isNull(), "unknown_price_base").alias("quarantine")
    )


@query(
    "p22_timing_diagnosis",
    """SELECT event_id AS seq, CASE WHEN event_id % 79 = 0 THEN 'AVAILABLE_BEFORE_EVENT' WHEN event_id % 73 = 0 THEN 'RECEIVED_BEFORE_EVENT' ELSE 'OK' END AS timing,
       CASE WHEN event_id % 79 = 0 THEN -1.0 ELSE (event_id % 7)::DOUBLE END AS delay,
       CASE WHEN event_id % 11 = 0 THEN 'INCOMPLETE' WHEN event_id % 9 = 0 THEN 'CROSSED' ELSE 'ORDERED' END AS relation FROM events""",
)
def p22_timing_diagnosis(spark, sf):
    t = spoiled_ticks(spark, sf)
    bid = F.when(F.col("seq") % 11 != 0, F.lit(10.0))
    ask = F.when(F.col("seq") % 9 == 0, F.lit(10.0)).otherwise(F.lit(11.0))
    return t.select(
        "seq", trade.timing_relation("event_time", "received_at", "available_at").alias("timing"),
        C.seconds_between("event_time", "available_at").alias("delay"), trade.quote_relation(bid, ask).alias("relation"),
    )


@query(
    "p23_research_year_label",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1995 OR year(o_orderdate) > 2001 THEN 'OUTSIDE' WHEN year(o_orderdate) >= 2001 THEN 'HOLDOUT_CLOSED'
         WHEN year(o_orderdate) < 1996 THEN 'WARMUP' WHEN year(o_orderdate) <= 1998 THEN 'DEV' ELSE 'WF_' || year(o_orderdate) END AS label FROM orders""",
)
def p23_research_year_label(spark, sf):
    o = I.table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", trade.research_year_label(at, 1995, 1996, 1998, 2000, 2001, 2001).alias("label"))


@query(
    "p24_dimension_resolution",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'row' WHEN event_id % 4 = 1 THEN 'k' || (props::JSON ->> 'k') ELSE 'UNKNOWN' END AS dimension FROM events""",
)
def p24_dimension_resolution(spark, sf):
    e = I.table(spark, sf, "events")
    row = F.when(F.col("event_id") % 4 == 0, "row").when(F.col("event_id") % 4 == 1, "  ")
    nested = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("k"), F.get_json_object("props", "$.k")))
    return e.select("event_id", C.first_filled(row, nested).alias("dimension"))


def repeated_ticks(spark, sf):
    """Ticks with late second copies of every 10th and a third copy of every 50th."""
    t = I.ticks(spark, sf)
    later = lambda every, s: t.where(F.col("seq") % every == 0).withColumn(
        "available_at", C.plus_seconds("available_at", s)
    )
    return t.unionByName(later(10, 30)).unionByName(later(50, 60))


@query(
    "d1_first_copy_wins",
    with_ctes(SQL["ticks"], select="""SELECT event_id, available_at, price,
        (CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END)::BIGINT AS duplicates FROM ticks"""),
)
def d1_first_copy_wins(spark, sf):
    order = ["event_time", C.effective_available().alias("a"), "seq"]
    return dedupe.first_wins(repeated_ticks(spark, sf), ["event_id"], order).select(
        "event_id", "available_at", "price", "duplicates"
    )


@query(
    "d2_canonical_order",
    with_ctes(SQL["ticks"], select="""SELECT instrument, seq, row_number() OVER (PARTITION BY instrument ORDER BY event_time, available_at, seq) AS position FROM ticks"""),
)
def d2_canonical_order(spark, sf):
    from tickloom.operators.scan import range_chunks, run_count, running

    keys, order = ["instrument"], ["event_time", "available_at", "seq"]
    rows = I.ticks(spark, sf).select(*keys, *order)
    return running(range_chunks(rows, keys, order), keys, order, {"position": run_count(F.lit(1))}).select(
        "instrument", "seq", "position"
    )


@query(
    "d3_out_of_order",
    with_ctes(
        SQL["ticks"],
        """o AS (SELECT *, seq * 10 + (seq % 7) * 15 AS ordinal FROM ticks),
           p AS (SELECT seq, instrument, event_time, lag(event_time) OVER (PARTITION BY instrument ORDER BY ordinal) AS prev FROM o)""",
        select="SELECT instrument, count(*) AS rows, count(*) FILTER (event_time < prev) AS out_of_order FROM p GROUP BY 1",
    ),
)
def d3_out_of_order(spark, sf):
    t = I.ticks(spark, sf).withColumn("ordinal", F.col("seq") * 10 + (F.col("seq") % 7) * 15)
    rows = dedupe.out_of_order(t.select("instrument", "ordinal", "event_time"), ["instrument"], "ordinal", "event_time")
    return rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"), F.count_if("out_of_order").alias("out_of_order"))


@query(
    "d4_capture_order",
    """SELECT event_id * 10 + (event_id % 7) * 15 AS ingest_sequence, CASE WHEN event_id % 41 <> 0 THEN ts + to_seconds(event_id % 7) END AS replay_at,
         CASE WHEN event_id % 60 = 0 THEN 'sequence_conflict' WHEN event_id % 41 = 0 THEN 'missing_instant' END AS issue,
         CASE WHEN event_id % 50 = 0 OR event_id % 60 = 0 THEN (event_id % 50 = 0)::BIGINT + (event_id % 60 = 0)::BIGINT
              + (event_id % 50 = 0 AND event_id % 60 = 0)::BIGINT ELSE 0 END AS collapsed FROM events""",
)
def d4_capture_order(spark, sf):
    from tickloom.plans.source_queries import capture_lines

    env = capture_lines(spark, sf)
    seq = F.get_json_object("payload", "$.seq").cast("bigint")
    changed = env.where(seq % 60 == 0).withColumn("payload", F.concat("payload", F.lit(" ")))
    out = dedupe.capture_order(env.unionByName(changed), dedupe.AS_OBSERVED)
    return out.select("ingest_sequence", "replay_at", "issue", "collapsed")


@query(
    "d5_mixed_replay_order",
    with_ctes(
        SQL["ticks"], sql_strict_bars(3600),
        """u AS (SELECT 'bar' AS kind, instrument, available_at AS known_at, 0 AS bl, -3600 AS sr, epoch_us(start) AS ordinal FROM bars
           UNION ALL SELECT 'tick', instrument, available_at, 1, 0, seq FROM ticks)""",
        select="SELECT kind, instrument, ordinal, row_number() OVER (ORDER BY known_at, bl, sr, ordinal, instrument) AS position FROM u",
    ),
)
def d5_mixed_replay_order(spark, sf):
    from tickloom.operators.scan import range_chunks, run_count, running

    stream = dedupe.replay_stream(I.strict_bars(spark, sf), I.ticks(spark, sf))
    ranked = running(range_chunks(stream, [], dedupe.REPLAY_KEYS), [], dedupe.REPLAY_KEYS, {"position": run_count(F.lit(1))})
    return ranked.select("kind", "instrument", "ordinal", "position")


@query(
    "d6_source_guard",
    """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS part, o_orderkey AS seq, o_orderdate AS t,
         'src:' || o_orderkey || CASE WHEN o_orderkey % 500 = 0 THEN 'x' ELSE '' END AS ident FROM orders),
       p AS (SELECT *, lag(t) OVER (PARTITION BY part ORDER BY seq) AS pt FROM r)
       SELECT part, 'identity_mismatch' AS issue, count(*) AS rows FROM p WHERE ident <> 'src:' || seq GROUP BY 1
       UNION ALL SELECT part, 'time_decreasing', count(*) FROM p WHERE t < pt GROUP BY 1""",
)
def d6_source_guard(spark, sf):
    o = I.table(spark, sf, "orders")
    tail = F.when(F.col("o_orderkey") % 500 == 0, "x").otherwise("")
    rows = o.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("part"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("t"), F.concat(F.lit("src:"), F.col("o_orderkey").cast("string"), tail).alias("ident"),
    )
    return dedupe.source_guard(rows, "part", "seq", "t", "ident", F.concat(F.lit("src:"), F.col("seq").cast("string")))


@query(
    "d7_dataset_fingerprint",
    """WITH h AS (SELECT event_type AS instrument, sha256(concat_ws('|', length(event_id::VARCHAR) || ':' || event_id, length(props) || ':' || props,
          length(event_type) || ':' || event_type)) AS h FROM events),
       b AS (SELECT instrument, ('0x' || substr(h, 1, 8))::BIGINT % 4096 AS b, count(*) AS n, sum(('0x' || substr(h, 9, 8))::BIGINT) AS s1,
          sum(('0x' || substr(h, 17, 8))::BIGINT) AS s2, sum(('0x' || substr(h, 25, 8))::BIGINT) AS s3 FROM h GROUP BY 1, 2)
       SELECT instrument, sum(n)::BIGINT AS rows, sha256(string_agg(concat_ws(':', b, n, s1, s2, s3), '|' ORDER BY b)) AS fingerprint FROM b GROUP BY 1""",
)
def d7_dataset_fingerprint(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", "props", F.col("event_type").alias("instrument"))
    return identity.dataset_fingerprint(e, ["instrument"])


@query(
    "d8_merge_results",
    """SELECT o_orderkey AS simulation_id, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS origin, o_totalprice AS net FROM orders""",
)
def d8_merge_results(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("simulation_id"), F.col("o_totalprice").alias("net"))
    first = o.where(F.col("simulation_id") % 3 != 0).withColumn("origin", F.lit("first"))
    second = o.where(F.col("simulation_id") % 2 == 0).unionByName(o.where(F.col("simulation_id") % 3 == 0)).withColumn("origin", F.lit("second"))
    return dedupe.merge_results([first, second], ["simulation_id"], ["net"])
