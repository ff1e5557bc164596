"""Adapters from the shared parquet tables to ticks, quotes, bars, ledger and marks.

Each adapter has a SQL twin in ``SQL`` so that a query and its oracle start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import plus_seconds
from tickloom.operators.bars import quote_bars, tick_bars
from tickloom.session import fit_input, pin, use_utc

# Largest quiet time between two ticks of one instrument that still counts as continuous.
CONTINUITY_SECONDS = 3 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    path = f"{sf_dir}/{name}.parquet"
    fit_input(spark, path)
    return spark.read.parquet(path)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: one per event, known up to six seconds after it happened."""
    e = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_type").alias("instrument"),
        at.alias("event_time"),
        plus_seconds(at, F.col("event_id") % 7).alias("available_at"),
        F.lit(None).cast("timestamp").alias("received_at"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("quantity"),
        F.lit(None).cast("double").alias("bid"),
        F.lit(None).cast("double").alias("ask"),
        F.lit("traded").alias("price_base"),
        F.lit("trade").alias("event_kind"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.lit("events").alias("source"),
        F.array(F.lit("valid")).alias("quality_flags"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided quotes with a spread of one to five cents; priced at the bid."""
    spread = F.lit(0.01) * (1 + F.col("seq") % 5)
    return ticks(spark, sf_dir).withColumns({
        "bid": F.col("price"), "ask": F.col("price") + spread, "price": F.lit(None).cast("double"),
        "quantity": F.lit(None).cast("double"), "price_base": F.lit("bid"), "event_kind": F.lit("quote"),
    })


def strict_bars(spark: SparkSession, sf_dir: str, tf: int = 3600) -> DataFrame:
    return tick_bars(ticks(spark, sf_dir), tf)


def bars(spark: SparkSession, sf_dir: str, tf: int | tuple[int, ...] = 4 * 3600) -> DataFrame:
    """Bars that are usable downstream: continuous up to the declared quiet time."""
    return pin(quote_bars(quotes(spark, sf_dir), tf, CONTINUITY_SECONDS))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per order line; cost is unknown for a tenth of the open lines.

    Amounts are worked out before the join, so that a query that needs the net alone shuffles one number a line for it.
    """
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    gross = (F.when(F.col("l_returnflag") == "R", -price).otherwise(price)).cast("decimal(18,4)")
    cost = F.when(
        ~((F.col("l_linestatus") == "O") & (F.col("l_partkey") % 10 == 0)),
        (price * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)"),
    )
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag",
        F.col("l_quantity").cast("decimal(18,2)").alias("units"), gross.alias("gross"), cost.alias("cost"),
        (gross - cost).cast("decimal(18,4)").alias("net"), F.col("l_tax").cast("decimal(4,2)").alias("tax_rate"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount_rate"), price.alias("notional"),
        F.col("l_shipdate").cast("timestamp").alias("_shipped"),
    )
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("_ordered")
    )
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        F.col("o_orderpriority").alias("variant"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("instrument"),
        F.when(F.col("l_linenumber") % 2 == 0, "DOWN").otherwise("UP").alias("direction"),
        "units",
        F.least("_ordered", "_shipped").alias("entry_at"),
        F.greatest("_ordered", "_shipped").alias("close_at"),
        "gross", "cost", "net",
        F.when(F.col("o_orderstatus") == "P", "OPEN").otherwise("CLOSED").alias("state"),
        F.col("l_linestatus").alias("session"),
        F.col("l_returnflag").alias("regime"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("episode_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("part_id"),
        "tax_rate", "discount_rate", "notional",
    )


def closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where("state = 'CLOSED'")


SQL: dict[str, str] = {}

SQL["ticks"] = """ticks AS (
  SELECT event_type AS instrument, ts AS event_time, ts + to_seconds(event_id % 7) AS available_at,
         value AS price, 1.0::DOUBLE AS quantity, event_id AS seq, 'e' || event_id AS event_id
  FROM events)"""

SQL["quotes"] = """quotes AS (
  SELECT event_type AS instrument, ts AS event_time, ts + to_seconds(event_id % 7) AS available_at,
         value AS bid, value + 0.01::DOUBLE * (1 + event_id % 5) AS ask, event_id AS seq,
         'e' || event_id AS event_id FROM events)"""

SQL["ledger"] = """ledger AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_id, o_orderpriority AS variant,
         'S' || (l_suppkey % 20) AS instrument,
         CASE WHEN l_linenumber % 2 = 0 THEN 'DOWN' ELSE 'UP' END AS direction,
         l_quantity::DECIMAL(18,2) AS units,
         least(o_orderdate, l_shipdate) AS entry_at, greatest(o_orderdate, l_shipdate) AS close_at,
         g.gross, g.cost, (g.gross - g.cost)::DECIMAL(18,4) AS net,
         CASE WHEN o_orderstatus = 'P' THEN 'OPEN' ELSE 'CLOSED' END AS state,
         l_linestatus AS session, l_returnflag AS regime, 'o' || l_orderkey AS episode_id,
         l_orderkey AS order_id, l_partkey AS part_id, l_tax::DECIMAL(4,2) AS tax_rate,
         l_discount::DECIMAL(4,2) AS discount_rate, l_extendedprice::DECIMAL(18,2) AS notional
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey,
  LATERAL (SELECT (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice::DECIMAL(18,2))::DECIMAL(18,4) AS gross,
           CASE WHEN NOT (l_linestatus = 'O' AND l_partkey % 10 = 0)
                THEN (l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2))::DECIMAL(18,4) END AS cost) g)"""


def sql_strict_bars(tf: int, name: str = "bars") -> str:
    """Strict tick bars as a CTE over ``ticks``."""
    return f"""{name}_raw AS (
  SELECT instrument, time_bucket(to_seconds({tf}), event_time, TIMESTAMP '1970-01-01') AS start,
         arg_min(price, (event_time, available_at, seq)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (event_time, available_at, seq)) AS close, sum(quantity) AS volume,
         count(*) AS event_count, min(event_time) AS first_event, max(event_time) AS last_event,
         arg_min(available_at, (event_time, available_at, seq)) AS first_avail, max(available_at) AS latest_avail
  FROM ticks GROUP BY 1, 2),
{name}_next AS (
  SELECT *, start + to_seconds({tf}) AS "end", first_event > start AS partial,
         lead(first_avail) OVER (PARTITION BY instrument ORDER BY start) AS opened_next FROM {name}_raw),
{name} AS (
  SELECT instrument, {tf} AS tf_seconds, start, "end", open, high, low, close, volume, event_count, partial,
         opened_next IS NOT NULL OR NOT partial AS closed,
         CASE WHEN opened_next IS NOT NULL THEN greatest("end", opened_next, latest_avail)
              WHEN NOT partial THEN greatest("end", latest_avail) ELSE latest_avail END AS available_at
  FROM {name}_next)"""


def sql_bars(tf: int = 4 * 3600, name: str = "bars", gap: int = CONTINUITY_SECONDS) -> str:
    """Continuous quote bars as a CTE over ``quotes``."""
    return f"""{name}_q AS (
  SELECT *, time_bucket(to_seconds({tf}), event_time, TIMESTAMP '1970-01-01') AS start,
         lag(event_time) OVER (PARTITION BY instrument ORDER BY event_time, seq) AS prev_time FROM quotes),
{name}_raw AS (
  SELECT instrument, start,
         arg_min(bid, (event_time, available_at, seq)) AS open, max(bid) AS high, min(bid) AS low,
         arg_max(bid, (event_time, available_at, seq)) AS close, 0.0::DOUBLE AS volume,
         count(*) AS event_count, min(event_time) AS first_event, max(event_time) AS last_event,
         arg_min(available_at, (event_time, available_at, seq)) AS first_avail, max(available_at) AS latest_avail,
         coalesce(max(CASE WHEN prev_time >= start THEN epoch_us(event_time) - epoch_us(prev_time) END), 0) / 1e6 AS inner_gap,
         arg_min((epoch_us(event_time) - epoch_us(prev_time)) / 1e6, (event_time, available_at, seq)) AS entry_gap
  FROM {name}_q GROUP BY 1, 2),
{name}_next AS (
  SELECT *, start + to_seconds({tf}) AS "end",
         lead(first_avail) OVER w AS opened_next,
         lag(start) OVER w + to_seconds({tf}) AS prev_end FROM {name}_raw WINDOW w AS (PARTITION BY instrument ORDER BY start)),
{name}_flag AS (
  SELECT *, first_event > start AND NOT coalesce(prev_end = start AND entry_gap BETWEEN 0 AND {gap}, false) AS partial,
         inner_gap > {gap} OR (epoch_us("end") - epoch_us(last_event)) / 1e6 > {gap} AS gap FROM {name}_next),
{name} AS (
  SELECT instrument, {tf} AS tf_seconds, start, "end", open, high, low, close, volume, event_count, partial, gap,
         opened_next IS NOT NULL OR NOT partial AS closed,
         (opened_next IS NOT NULL OR NOT partial) AND NOT partial AND NOT gap AS valid,
         CASE WHEN opened_next IS NOT NULL THEN greatest("end", opened_next, latest_avail)
              WHEN NOT partial THEN greatest("end", latest_avail) ELSE latest_avail END AS available_at
  FROM {name}_flag)"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
