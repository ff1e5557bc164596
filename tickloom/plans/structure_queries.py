"""Queries over market structure, gaps, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import session_label
from tickloom.functions.quality import validate_ticks
from tickloom.operators import bars as B
from tickloom.operators import paging as P
from tickloom.operators import structure as M
from tickloom.operators.scan import union_all
from tickloom.plans import inputs as I
from tickloom.plans.indicator_queries import H4, POINTS, points
from tickloom.plans.inputs import SQL, sql_bars, sql_strict_bars, with_ctes
from tickloom.plans.registry import query, rnd, text_list

T, Q = SQL["ticks"], SQL["quotes"]


@query(
    "a3_bar_resample",
    with_ctes(
        Q, sql_bars(H4, "b4"),
        """g AS (SELECT instrument, time_bucket(INTERVAL 12 HOUR, start, TIMESTAMP '1970-01-01') AS at12, arg_min(open, start) AS open, max(high) AS high, min(low) AS low,
             arg_max(close, start) AS close, sum(event_count)::BIGINT AS event_count, count(*) AS parts, count(DISTINCT start) AS starts, bool_and(closed) AS closed FROM b4 GROUP BY 1, 2)""",
        select="SELECT instrument, at12 AS start, open, high, low, close, event_count, parts, parts = 3 AND starts = 3 AND closed AS complete FROM g",
    ),
)
def a3_bar_resample(spark, sf):
    out = B.resample(I.bars(spark, sf, H4), 12 * 3600)
    return out.select("instrument", "start", "open", "high", "low", "close", "event_count", "parts", "complete")


@query(
    "a3_native_bars_preferred",
    with_ctes(
        T, sql_strict_bars(3600),
        select="""SELECT instrument, start, CASE WHEN event_count > 2 THEN close + 1 ELSE close END AS close, CASE WHEN event_count > 2 THEN 'native' ELSE 'derived' END AS origin FROM bars""",
    ),
)
def a3_native_bars_preferred(spark, sf):
    derived = I.strict_bars(spark, sf)
    native = derived.where("event_count > 2").withColumn("close", F.col("close") + 1)
    return B.prefer_native(native, derived).select("instrument", "start", "close", "origin")


@query(
    "a4_bounded_distribution",
    with_ctes(
        T,
        """h AS (SELECT instrument, least(floor(price / 0.5), 200)::BIGINT AS b, count(*) AS c FROM ticks GROUP BY 1, 2),
           r AS (SELECT *, sum(c) OVER (PARTITION BY instrument ORDER BY b) AS cum, sum(c) OVER (PARTITION BY instrument) AS n FROM h),
           q AS (SELECT instrument, min(CASE WHEN cum >= ceil(0.5 * n) THEN b END) AS b50, min(CASE WHEN cum >= ceil(0.9 * n) THEN b END) AS b90, min(CASE WHEN cum >= ceil(0.99 * n) THEN b END) AS b99 FROM r GROUP BY 1)""",
        select="""SELECT t.instrument, count(*) AS n, round(avg(price), 6) AS mean, round(var_pop(price), 4) AS variance, min(price) AS min, max(price) AS max,
            any_value(b50) * 0.5::DOUBLE AS p50_lower, any_value(b90) * 0.5::DOUBLE AS p90_lower, CASE WHEN any_value(b99) < 200 THEN (any_value(b99) + 1) * 0.5::DOUBLE END AS p99_upper
            FROM ticks t JOIN q USING (instrument) GROUP BY 1""",
    ),
)
def a4_bounded_distribution(spark, sf):
    out = B.histogram_quantiles(I.ticks(spark, sf), ["instrument"], "price", width=0.5, bins=200)
    return out.select("instrument", "n", rnd("mean"), rnd("variance", 4), "min", "max", "p50_lower", "p90_lower", "p99_upper")


GAPS = """gp AS (SELECT *, lag(event_time) OVER w AS pt, lag(ask - bid) OVER w AS ps, (epoch_us(event_time) - epoch_us(lag(event_time) OVER w)) / 1e6 AS gap
   FROM quotes WINDOW w AS (PARTITION BY instrument ORDER BY event_time, seq))"""


@query(
    "a5_quote_structure",
    with_ctes(
        Q, GAPS,
        select="""SELECT instrument, count(*) AS quotes, min(event_time) AS first_quote, max(event_time) AS last_quote, count(*) FILTER (gap = 0) AS equal_times, count(*) FILTER (gap > 3600) AS gaps_over_bound,
            round(sum(CASE WHEN gap <= 3600 THEN gap END), 6) AS covered_seconds, round(sum(CASE WHEN gap <= 3600 THEN gap * ps END) / sum(CASE WHEN gap <= 3600 THEN gap END), 6) AS time_weighted_spread FROM gp GROUP BY 1""",
    ),
)
def a5_quote_structure(spark, sf):
    out = M.quote_structure(M.quote_gaps(I.quotes(spark, sf)), 3600)
    return out.select("instrument", "quotes", "first_quote", "last_quote", "equal_times", "gaps_over_bound", rnd("covered_seconds"), rnd("time_weighted_spread"))


@query(
    "a5_spread_by_hour_and_block",
    with_ctes(
        Q,
        """g AS (SELECT instrument, ask - bid AS s, unnest([('overall', 'ALL'), ('hour', hour(event_time)::VARCHAR), ('block', (hour(event_time) // 8)::VARCHAR)]) AS p FROM quotes)""",
        select="""SELECT instrument, p[1] AS kind, p[2] AS label, count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS min, round(max(s), 6) AS max FROM g GROUP BY 1, 2, 3""",
    ),
)
def a5_spread_by_hour_and_block(spark, sf):
    out = M.spread_distribution(I.quotes(spark, sf))
    return out.select("instrument", "kind", "label", "n", rnd("mean"), rnd("min"), rnd("max"))


@query(
    "a5_daily_coverage",
    with_ctes(Q, select="SELECT instrument, event_time::DATE::TIMESTAMP AS day, count(*) AS ticks, min(event_time) AS first_quote, max(event_time) AS last_quote FROM quotes GROUP BY 1, 2"),
)
def a5_daily_coverage(spark, sf):
    return M.daily_coverage(I.quotes(spark, sf)).withColumn("day", F.col("day").cast("timestamp"))


@query(
    "a6_return_structure",
    with_ctes(
        Q, sql_bars(H4),
        """l AS (SELECT *, lag("end") OVER w AS pe, lag(close) OVER w AS pc, lag(valid) OVER w AS pv FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY start)),
           r AS (SELECT *, CASE WHEN valid AND pv AND pe = start THEN ln(close / pc) END AS r FROM l),
           r2 AS (SELECT *, CASE WHEN valid AND pv AND pe = start THEN lag(r) OVER (PARTITION BY instrument ORDER BY start) END AS r0 FROM r)""",
        select="""SELECT instrument, count(*) AS bars, count(*) FILTER (valid) AS valid_bars, count(r) AS returns, round(sqrt(sum(r * r)), 6) AS realized, count(*) FILTER (r IS NOT NULL AND r0 IS NOT NULL) AS pairs,
            round(corr(r0, r) FILTER (r IS NOT NULL AND r0 IS NOT NULL), 6) AS lag1_corr FROM r2 GROUP BY 1""",
    ),
)
def a6_return_structure(spark, sf):
    out = B.return_structure(I.bars(spark, sf, H4))
    return out.select("instrument", "bars", "valid_bars", "returns", rnd("realized"), "pairs", rnd("lag1_corr"))


def sql_summary(v: str) -> str:
    return f"count({v}) AS known, count(*) - count({v}) AS unknown, round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.95), 6) AS p95"


@query(
    "a8_spread_report",
    with_ctes(
        Q,
        """u AS (SELECT seq, event_time, CASE WHEN seq % 53 <> 0 THEN ask - bid END AS s, CASE WHEN seq % 4 <> 0 THEN (seq % 4)::DOUBLE END AS atr, CASE WHEN seq % 2 = 0 THEN 'M1' ELSE 'M5' END AS tf FROM quotes),
           g AS (SELECT s, s / atr AS ra, unnest([('overall', 'ALL'), ('timeframe', tf), ('hour', hour(event_time)::VARCHAR), ('session', CASE WHEN hour(event_time) < 7 THEN 'ASIA' WHEN hour(event_time) < 12 THEN 'LONDON'
             WHEN hour(event_time) < 17 THEN 'NEW_YORK' WHEN hour(event_time) < 22 THEN 'NY_LATE' ELSE 'OFF' END)]) AS p FROM u)""",
        select=f"SELECT p[1] AS kind, p[2] AS label, {sql_summary('s')}, count(ra) AS atr_known, round(avg(ra), 6) AS atr_mean, round(quantile_cont(ra, 0.95), 6) AS atr_p95 FROM g GROUP BY 1, 2",
    ),
)
def a8_spread_report(spark, sf):
    q = I.quotes(spark, sf).withColumns({
        "ask": F.when(F.col("seq") % 53 == 0, F.col("bid") - 1).otherwise(F.col("ask")),
        "atr": F.when(F.col("seq") % 4 != 0, (F.col("seq") % 4).cast("double")),
    })
    twice = q.unionByName(q.where(F.col("seq") % 10 == 0))
    out = M.spread_report(twice, session=session_label("event_time"), timeframe=F.when(F.col("seq") % 2 == 0, "M1").otherwise("M5"))
    return out.select("kind", "label", "known", "unknown", rnd("mean"), rnd("p50"), rnd("p95"), "atr_known", rnd("atr_mean"), rnd("atr_p95"))


@query(
    "a32_quality_summary",
    """WITH r AS (SELECT event_type AS instrument, event_id, ts, value, event_id * 10 + (event_id % 7) * 15 AS ing FROM events
         UNION ALL SELECT event_type, event_id, ts, value, 100000000 + event_id FROM events WHERE event_id % 20 = 0),
       p AS (SELECT *, lag(ts) OVER (PARTITION BY instrument ORDER BY ing) AS prev FROM r)
       SELECT instrument, count(*) AS records, count(*) FILTER (ts < prev) AS out_of_order, count(*) FILTER (value < 1) AS invalid, min(ts) AS coverage_start, max(ts) AS coverage_end,
         count(*) - count(DISTINCT event_id) AS duplicates FROM p GROUP BY 1""",
)
def a32_quality_summary(spark, sf):
    t = I.ticks(spark, sf)
    rows = t.withColumn("ing", F.col("seq") * 10 + (F.col("seq") % 7) * 15)
    rows = rows.unionByName(t.where(F.col("seq") % 20 == 0).withColumn("ing", F.lit(100000000) + F.col("seq")))
    return M.quality_summary(rows, ["instrument"], time="event_time", ingest="ing", ident="event_id", invalid=F.col("price") < 1)


@query(
    "a40_coverage_completeness",
    """WITH g AS (SELECT event_type AS instrument, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
       SELECT instrument, min(ts) AS observed_start, max(ts) AS observed_end, bool_and(event_id % 1000 <> 7) AS availability_known, CASE WHEN max(gap) <= 9000 THEN 'CONTINUOUS' ELSE 'DISCONTINUOUS' END AS continuity,
         min(ts) <= TIMESTAMP '2024-01-01 00:10:00' AND max(ts) >= TIMESTAMP '2024-01-30 23:00:00' AS range_covered FROM g GROUP BY 1""",
)
def a40_coverage_completeness(spark, sf):
    t = I.ticks(spark, sf).withColumn("available_at", F.when(F.col("seq") % 1000 != 7, F.col("available_at")))
    out = M.coverage(
        t, ["instrument"], clock="event_time", requested=("2024-01-01 00:10:00", "2024-01-30 23:00:00"), max_gap=9000, available="available_at"
    )
    return out.drop("complete")


@query(
    "w9_bar_gaps",
    with_ctes(
        T, sql_strict_bars(3600),
        """l AS (SELECT *, lag("end") OVER w AS gap_start, lag(start) OVER w AS previous_start FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY start))""",
        select="SELECT instrument, gap_start, start AS gap_end, (epoch_us(start) - epoch_us(gap_start)) / 1e6 AS seconds, previous_start FROM l WHERE start > gap_start",
    ),
)
def w9_bar_gaps(spark, sf):
    return B.bar_gaps(I.strict_bars(spark, sf)).select("instrument", "gap_start", "gap_end", "seconds", "previous_start")


@query("w12_inter_quote_gap", with_ctes(Q, GAPS, select="SELECT instrument, seq, pt AS prev_time, gap, round(ps, 6) AS prev_spread FROM gp"))
def w12_inter_quote_gap(spark, sf):
    return M.quote_gaps(I.quotes(spark, sf)).select("instrument", "seq", "prev_time", "gap", rnd("prev_spread"))


@query(
    "w14_evidence_rank",
    with_ctes(
        SQL["ledger"],
        "s AS (SELECT instrument, sum(net) AS net, count(*) FILTER (cost IS NULL) AS unknown FROM ledger GROUP BY 1)",
        select="SELECT instrument, rank() OVER (ORDER BY unknown) AS cost_rank, row_number() OVER (ORDER BY net DESC, instrument) AS net_position FROM s",
    ),
)
def w14_evidence_rank(spark, sf):
    from pyspark.sql import Window

    s = I.ledger(spark, sf).groupBy("instrument").agg(F.sum("net").alias("net"), F.count_if(F.col("cost").isNull()).alias("unknown"))
    return s.select(  # one row per instrument
        "instrument", F.rank().over(Window.orderBy("unknown")).cast("bigint").alias("cost_rank"),
        F.row_number().over(Window.orderBy(F.desc("net"), "instrument")).cast("bigint").alias("net_position"),
    )


@query(
    "w15_last_contiguous_run",
    with_ctes(
        T, sql_strict_bars(3600),
        """u AS (SELECT *, start <> coalesce(lag("end") OVER (PARTITION BY instrument ORDER BY start), start) AS brk FROM bars WHERE closed AND "end" <= TIMESTAMP '2024-01-25'),
           i AS (SELECT *, sum(brk::INT) OVER (PARTITION BY instrument ORDER BY start) AS isl FROM u),
           r AS (SELECT instrument, isl, count(*) AS run_length, min(start) AS run_start, max("end") AS run_end FROM i GROUP BY 1, 2)""",
        select="SELECT instrument, run_length, run_start, run_end, run_length >= 20 AS ready FROM r QUALIFY isl = max(isl) OVER (PARTITION BY instrument)",
    ),
)
def w15_last_contiguous_run(spark, sf):
    out = B.last_contiguous_run(I.strict_bars(spark, sf), F.lit("2024-01-25").cast("timestamp"), 20)
    return out.drop("tf_seconds")


SPEC = P.PageSpec("ticks", "event_time", "seq", 50, filters=(("instrument", "click"),), start="2024-01-05", end="2024-01-25")


@query(
    "q1_keyset_page",
    with_ctes(
        T,
        select="""SELECT instrument, seq, event_time, price FROM ticks WHERE instrument = 'click' AND event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-25'
            AND (event_time, seq) > (TIMESTAMP '2024-01-09 12:00:00', 100) ORDER BY event_time, seq LIMIT 51""",
    ),
)
def q1_keyset_page(spark, sf):
    cursor = P.encode_cursor(SPEC, 1704801600000000, 100)
    return P.page(I.ticks(spark, sf), SPEC, cursor).select("instrument", "seq", "event_time", "price")


@query(
    "q2_conditions_page",
    """WITH e AS (SELECT event_id AS seq, ts, [CASE WHEN event_id % 101 = 0 THEN 'instrument_missing' END, CASE WHEN event_id % 97 = 0 THEN 'non_finite' END,
         CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN 'price_base_missing' END, CASE WHEN event_id % 83 = 0 THEN 'quantity_negative' END] AS l FROM events),
       f AS (SELECT seq, ts, list_filter(l, lambda x: x IS NOT NULL) AS l FROM e)
       SELECT seq, ts AS event_time, (i - 1)::DOUBLE AS ordinal, l[i] AS condition FROM f, LATERAL (SELECT unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE range(1, len(l) + 1) END) AS i)""",
)
def q2_conditions_page(spark, sf):
    from tickloom.plans.row_queries import spoiled_ticks

    clean = spoiled_ticks(spark, sf).withColumns({"quality_flags": F.array(F.lit("valid")), "received_at": F.lit(None).cast("timestamp"), "available_at": F.col("event_time")})
    out = P.explode_conditions(validate_ticks(clean), "issues", ["seq", "event_time"])
    return out.withColumn("ordinal", F.col("ordinal").cast("double"))


@query(
    "q3_even_downsample",
    with_ctes(
        T,
        """r AS (SELECT instrument, seq, row_number() OVER (PARTITION BY instrument ORDER BY event_time, seq) - 1 AS k, count(*) OVER (PARTITION BY instrument) AS n FROM ticks),
           w AS (SELECT DISTINCT instrument, round_even(i * (n - 1) / 99.0::DOUBLE, 0)::BIGINT AS k FROM (SELECT DISTINCT instrument, n FROM r), range(100) t(i))""",
        select="SELECT r.instrument, r.seq FROM r JOIN w USING (instrument, k)",
    ),
)
def q3_even_downsample(spark, sf):
    rows = I.ticks(spark, sf).select("instrument", "event_time", "seq")
    return P.downsample(rows, ["instrument"], ["event_time", "seq"], 100).select("instrument", "seq")


@query(
    "q4_largest_gaps",
    with_ctes(
        Q, GAPS,
        select="SELECT instrument, seq, gap, row_number() OVER (PARTITION BY instrument ORDER BY gap DESC, seq) AS position FROM gp WHERE gap IS NOT NULL QUALIFY position <= 16",
    ),
)
def q4_largest_gaps(spark, sf):
    gaps = M.quote_gaps(I.quotes(spark, sf)).where("gap IS NOT NULL")
    return M.largest(gaps, ["instrument"], "gap", "seq", 16).select("instrument", "seq", "gap", F.col("position").cast("bigint").alias("position"))


@query(
    "q5_bounded_poll",
    with_ctes(
        T, sql_strict_bars(3600), SQL["ledger"],
        """a AS (SELECT 'ticks' AS source, event_time AS "at", seq::VARCHAR AS ident FROM ticks ORDER BY event_time DESC, seq DESC LIMIT 20),
           b AS (SELECT 'bars' AS source, "end" AS "at", instrument AS ident FROM bars ORDER BY "end" DESC, instrument DESC LIMIT 20),
           c AS (SELECT 'trades' AS source, close_at AS "at", trade_id AS ident FROM ledger ORDER BY close_at DESC, trade_id DESC LIMIT 20)""",
        select='SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c',
    ),
)
def q5_bounded_poll(spark, sf):
    return union_all([
        P.latest(I.ticks(spark, sf), "event_time", "seq", 20, "ticks"),
        P.latest(I.strict_bars(spark, sf), "end", "instrument", 20, "bars"),
        P.latest(I.ledger(spark, sf), "close_at", "trade_id", 20, "trades"),
    ])


@query(
    "q6_typed_pages",
    with_ctes(
        SQL["ledger"],
        select="""SELECT trade_id, close_at, net::DOUBLE AS net FROM ledger WHERE state = 'CLOSED' AND direction = 'UP' AND (close_at, trade_id) < (TIMESTAMP '1999-01-01', '~') ORDER BY close_at DESC, trade_id DESC LIMIT 31""",
    ),
)
def q6_typed_pages(spark, sf):
    spec = P.PageSpec("trades", "close_at", "trade_id", 30, descending=True, filters=(("state", "CLOSED"), ("direction", "UP")))
    cursor = P.encode_cursor(spec, 915148800000000, "~")
    return P.page(I.ledger(spark, sf), spec, cursor).select("trade_id", "close_at", "net")


@query(
    "p18_table_filters",
    with_ctes(
        T, sql_strict_bars(3600),
        select="SELECT instrument, start, close FROM bars WHERE start >= TIMESTAMP '2024-01-05' AND start < TIMESTAMP '2024-01-12' AND instrument IN ('click', 'view') AND closed",
    ),
)
def p18_table_filters(spark, sf):
    spec = P.PageSpec("bars", "start", "instrument", 50, filters=(("instrument", ("click", "view")), ("closed", True)), start="2024-01-05", end="2024-01-12")
    return P.selected(I.strict_bars(spark, sf), spec).select("instrument", "start", "close")


@query(
    "p19_nested_dimension_filter",
    """SELECT event_id, event_type, value FROM events WHERE (props::JSON ->> 'k')::INT = 42 AND event_type = 'view'""",
)
def p19_nested_dimension_filter(spark, sf):
    e = I.table(spark, sf, "events")
    paths = {"k": F.get_json_object("props", "$.k").cast("int"), "instrument": F.col("event_type")}
    return P.dimension_filter(e, {"instrument": "view", "k": 42}, paths).select("event_id", "event_type", "value")


@query("u1_key_union", "SELECT count(*) AS keys FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem)")
def u1_key_union(spark, sf):
    o, li = I.table(spark, sf, "orders"), I.table(spark, sf, "lineitem")
    keys = o.select(F.col("o_orderkey").alias("k")).union(li.select("l_orderkey")).distinct()
    return keys.agg(F.count(F.lit(1)).alias("keys"))


@query(
    "u2_block_intersection",
    """SELECT block FROM (SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE) // 7 AS block FROM orders INTERSECT SELECT date_diff('day', DATE '1970-01-01', l_shipdate::DATE) // 7 FROM lineitem)""",
)
def u2_block_intersection(spark, sf):
    from tickloom.functions.columns import day_block

    o, li = I.table(spark, sf, "orders"), I.table(spark, sf, "lineitem")
    blocks = lambda df, c: df.select(day_block(F.to_date(c), 7).alias("block"))
    return blocks(o, "o_orderdate").intersect(blocks(li, "l_shipdate"))


@query(
    "u3_missing_bars",
    with_ctes(
        T, sql_strict_bars(3600),
        """b AS (SELECT instrument, min(start) AS lo, max(start) AS hi FROM bars GROUP BY 1),
           e AS (SELECT instrument, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS start FROM b)""",
        select="SELECT instrument, start FROM e EXCEPT SELECT instrument, start FROM bars",
    ),
)
def u3_missing_bars(spark, sf):
    return B.missing_intervals(I.strict_bars(spark, sf)).select("instrument", "start")


@query(
    "u4_replay_union",
    with_ctes(
        T, sql_strict_bars(3600),
        select="""SELECT kind, instrument, count(*) AS rows, max(known_at) AS last_known FROM (SELECT 'bar' AS kind, instrument, available_at AS known_at FROM bars
            UNION ALL SELECT 'tick', instrument, available_at FROM ticks) GROUP BY 1, 2""",
    ),
)
def u4_replay_union(spark, sf):
    from tickloom.operators.dedupe import replay_stream

    return replay_stream(I.strict_bars(spark, sf), I.ticks(spark, sf)).groupBy("kind", "instrument").agg(
        F.count(F.lit(1)).alias("rows"), F.max("known_at").alias("last_known")
    )
