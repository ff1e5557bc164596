"""Streaming queries: each replays the whole shared table in several micro-batches, then stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import plus_seconds
from tickloom.operators.indicators import Periods
from tickloom.plans import inputs as I
from tickloom.plans.indicator_queries import BASE, H4, POINTS, x2_rule_signals
from tickloom.plans.inputs import SQL, sql_strict_bars, with_ctes
from tickloom.plans.join_queries import HORIZONS, LABELLED, RULE, one_sided
from tickloom.plans.registry import ORACLES, query, rnd
from tickloom.plans.row_queries import repeated_ticks
from tickloom.session import pin, scratch_path, shuffle_width
from tickloom.streaming import bars as SB
from tickloom.streaming import jobs, stateful
from tickloom.streaming.pending import pending_outcomes
from tickloom.streaming.support import guard_checkpoint, run_available

T = SQL["ticks"]


def replay(spark, rows, order: str, parts: int = 4):
    """The rows as a stream of ``parts`` micro-batches, oldest first by ``order``.

    Every micro-batch is written by all tasks and read as as many files; only a micro-batch of fewer rows than files is one file, and so are all then.
    """
    rows = pin(rows)
    micros = F.unix_micros(order) if dict(rows.dtypes)[order] == "timestamp" else F.col(order).cast("bigint")
    lo, hi = rows.agg(F.min(micros), F.max(micros)).first()
    step = max(1, -(-(hi - lo + 1) // parts))
    dealt = rows.withColumn("_part", F.least(F.floor((micros - lo) / step), F.lit(parts - 1)).cast("int"))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    files = shuffle_width(spark)
    files = files if min(sizes.values()) >= 100 * files else 1
    path = scratch_path(spark, "stream")
    for i in sorted(sizes):
        dealt.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def to_table(spark, stream):
    path = scratch_path(spark, "sink")
    run_available(stream, scratch_path(spark, "checkpoint"), sink=path)
    return spark.read.schema(stream.schema).parquet(path)


def sql_stream_bars(tf: int, delay: int = 600) -> str:
    return with_ctes(
        T, sql_strict_bars(tf), f"wm AS (SELECT epoch_ms(max(event_time)) - {delay * 1000} AS ms FROM ticks)",
        select='SELECT instrument, start, "end", open, high, low, close, volume, event_count, partial FROM bars, wm WHERE epoch_ms("end") <= ms',
    )


def stream_bar_rows(spark, sf, tf):
    out = to_table(spark, SB.stream_bars(replay(spark, I.ticks(spark, sf), "event_time"), tf))
    return out.select("instrument", "start", "end", "open", "high", "low", "close", "volume", "event_count", "partial")


@query("t1_stream_bars", sql_stream_bars(3600))
def t1_stream_bars(spark, sf):
    return stream_bar_rows(spark, sf, 3600)


@query("t2_close_on_watermark", sql_stream_bars(300))
def t2_close_on_watermark(spark, sf):
    return stream_bar_rows(spark, sf, 300)


LATE_SQL = """WITH t AS (SELECT event_type AS instrument, event_id, ts, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start,
          CASE WHEN event_id % 40 = 0 THEN event_id + 3000000000 ELSE event_id END AS arrival FROM events),
        s AS (SELECT *, max(start) OVER (PARTITION BY instrument ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t)
        SELECT instrument, event_id AS seq, start < seen AS late FROM s WHERE start < seen"""


def late_rows(spark, sf, parts: int):
    t = I.ticks(spark, sf).select("instrument", "seq", "event_time", "price")
    t = t.withColumn("arrival", F.when(F.col("seq") % 40 == 0, F.col("seq") + 3000000000).otherwise(F.col("seq")))
    stream = replay(spark, t, "arrival", parts)
    recorder = SB.LateRecorder(spark, scratch_path(spark, "late"), 3600, stream.schema)
    run_available(stream, scratch_path(spark, "checkpoint"), each=recorder)
    return recorder.late.read().select("instrument", "seq", (F.col("issue") == "late_closed_interval").alias("late"))


@query("t3_late_rows_recorded", LATE_SQL)
def t3_late_rows_recorded(spark, sf):
    return late_rows(spark, sf, 4)


@query("t3_late_rows_one_batch", LATE_SQL)
def t3_late_rows_one_batch(spark, sf):
    """The same rows are late when everything arrives in one micro-batch."""
    return late_rows(spark, sf, 1)


@query("t4_stream_dedupe", with_ctes(T, select="SELECT event_id, price FROM ticks"))
def t4_stream_dedupe(spark, sf):
    stream = replay(spark, repeated_ticks(spark, sf), "event_time")
    return to_table(spark, SB.first_seen(stream)).select("event_id", "price")


IND_SELECT = "SELECT instrument, start, round(ema_fast, 6) AS ema_fast, round(ema_slow, 6) AS ema_slow, round(rsi, 6) AS rsi, round(atr, 6) AS atr FROM points"
IND_COLUMNS = ["ema_fast", "ema_slow", "rsi", "atr"]


@query("t5_stream_indicators", with_ctes(*POINTS, select=IND_SELECT))
def t5_stream_indicators(spark, sf):
    stream = replay(spark, I.bars(spark, sf, H4), "start")
    return to_table(spark, stateful.stream_indicators(stream)).select("instrument", "start", *map(rnd, IND_COLUMNS))


@query("t6_stream_quote_book", ORACLES["j9_quote_book"])
def t6_stream_quote_book(spark, sf):
    job = jobs.BookJob(spark, scratch_path(spark, "book"))
    run_available(replay(spark, one_sided(spark, sf), "arrival"), scratch_path(spark, "checkpoint"), each=job)
    return job.book.read().select("instrument", "arrival", "bid", "ask", "status")


@query(
    "t7_pending_outcomes",
    with_ctes(*LABELLED, select="""SELECT simulation_id, horizon, entry_price, final_price, outcome, round(net, 6) AS net FROM outc"""),
)
def t7_pending_outcomes(spark, sf):
    out = to_table(spark, pending_outcomes(replay(spark, capture(spark, sf), "at"), HORIZONS, RULE))
    return out.select("simulation_id", "horizon", "entry_price", "final_price", "outcome", rnd("net"))


def capture(spark, sf):
    """Signals and points in the order in which they become known, and the row that closes the capture."""
    from tickloom.operators import outcomes

    sig = x2_rule_signals(spark, sf).select("signal_id", "instrument", "direction", "detected_at", F.lit("signal").alias("kind"), F.col("detected_at").alias("at"))
    pts = outcomes.points_from_ticks(I.quotes(spark, sf), F.col("bid")).withColumns({"kind": F.lit("point"), "at": F.col("available_at")})
    both = pin(sig.unionByName(pts, allowMissingColumns=True))
    end = both.groupBy(F.lit("close").alias("kind")).agg(F.max("at").alias("at")).select("kind", F.lit("").alias("instrument"), plus_seconds("at", 7 * 86400).alias("at"))
    return both.unionByName(end, allowMissingColumns=True)


@query(
    "t7_pending_after_restart",
    with_ctes(*LABELLED, select="""SELECT simulation_id, horizon, entry_price, final_price, outcome, round(net, 6) AS net FROM outc"""),
)
def t7_pending_after_restart(spark, sf):
    """Three runs over one guarded checkpoint; what is pending when a run ends settles in a later one."""
    rows = pin(capture(spark, sf))
    lo, hi = rows.where("kind <> 'close'").agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    path, sink, root = scratch_path(spark, "stream"), scratch_path(spark, "sink"), scratch_path(spark, "guarded")
    part = F.floor((F.unix_micros("at") - lo) * 2 / (hi - lo + 1))  # the closing row comes alone
    for own in (part == 0, part == 1, part > 1):
        rows.where(own).write.mode("append").parquet(path)
        stream = pending_outcomes(spark.readStream.schema(rows.schema).parquet(path), HORIZONS, RULE)
        run_available(stream, guard_checkpoint(spark, root, {"horizons": HORIZONS, "rule": str(RULE)}), sink=sink)
    return spark.read.schema(stream.schema).parquet(sink).select("simulation_id", "horizon", "entry_price", "final_price", "outcome", rnd("net"))


@query(
    "t8_stream_signals",
    with_ctes(
        *BASE,
        """ch AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS upper, min(low) OVER w AS lower, bool_and(closed AND valid) OVER w AS all_ok, max(available_at) OVER w AS known FROM bars
             WINDOW w AS (PARTITION BY instrument ORDER BY start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
        select="""SELECT instrument, CASE WHEN close > upper THEN 'UP' ELSE 'DOWN' END AS direction, available_at AS detected_at FROM ch
             WHERE closed AND valid AND n >= 20 AND all_ok AND known <= available_at AND (close > upper OR close < lower)""",
    ),
)
def t8_stream_signals(spark, sf):
    stream = replay(spark, I.bars(spark, sf, H4), "start")
    job = jobs.SignalJob(spark, scratch_path(spark, "signals"), stream.schema)
    run_available(stream, scratch_path(spark, "checkpoint"), each=job)
    return job.signals.read().select("instrument", "direction", "detected_at")


@query("t9_restart_continues", with_ctes(*POINTS, select=IND_SELECT))
def t9_restart_continues(spark, sf):
    """Two runs over the same checkpoint: half of the bars, then the rest."""
    bars = I.bars(spark, sf, H4)
    middle = "2024-01-16"
    path, sink = scratch_path(spark, "stream"), scratch_path(spark, "sink")
    config = {"periods": str(Periods()), "tf": H4}
    root = scratch_path(spark, "guarded")
    for part in (bars.where(F.col("start") < middle), bars.where(F.col("start") >= middle)):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = stateful.stream_indicators(spark.readStream.schema(bars.schema).parquet(path))
        run_available(stream, guard_checkpoint(spark, root, config), sink=sink)
    return spark.read.schema(stream.schema).parquet(sink).select("instrument", "start", *map(rnd, IND_COLUMNS))


@query(
    "t10_status_snapshot",
    with_ctes(
        T, sql_strict_bars(3600), "now AS (SELECT max(available_at) + INTERVAL 2 HOUR AS now FROM bars)",
        """l AS (SELECT instrument, max(available_at) AS r, max(CASE WHEN closed THEN "end" END) AS c FROM bars GROUP BY 1)""",
        select="""SELECT instrument, r AS last_received, c AS last_closed, CASE WHEN (epoch_us(now) - epoch_us(r)) / 1e6 > 7500 THEN 'stale' WHEN (epoch_us(now) - epoch_us(c)) / 1e6 > 9000 THEN 'late' ELSE 'valid' END AS state FROM l, now""",
    ),
)
def t10_status_snapshot(spark, sf):
    b = pin(I.strict_bars(spark, sf))
    now = b.agg(F.max("available_at").alias("t")).select(plus_seconds("t", 7200)).scalar()
    return jobs.status_snapshot(b, now, max_feed_age=7500, max_bar_age=9000).select("instrument", "last_received", "last_closed", "state")


@query(
    "t11_native_over_derived",
    with_ctes(
        T, sql_strict_bars(3600),
        select="""SELECT instrument, start, CASE WHEN event_count > 2 THEN close + 1 ELSE close END AS close, CASE WHEN event_count > 2 THEN 'native' ELSE 'derived' END AS origin FROM bars""",
    ),
)
def t11_native_over_derived(spark, sf):
    derived = I.strict_bars(spark, sf).withColumn("origin", F.lit("derived"))
    native = derived.where("event_count > 2").withColumns({"close": F.col("close") + 1, "origin": F.lit("native")})
    again = native.where("event_count > 4")
    stream = replay(spark, derived.unionByName(native).unionByName(again), "start")
    merge = SB.NativePreferred(spark, scratch_path(spark, "merged"), stream.schema)
    run_available(stream, scratch_path(spark, "checkpoint"), each=merge)
    return merge.current().select("instrument", "start", "close", "origin")


@query(
    "t12_activity_sessions",
    """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 14400000000, true) AS new FROM events),
       s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g), wm AS (SELECT epoch_ms(max(ts)) - 600000 AS ms FROM events),
       a AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, sid)
       SELECT user_id, start, "end", events FROM a, wm WHERE epoch_ms("end") <= ms""",
)
def t12_activity_sessions(spark, sf):
    rows = I.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("event_time"))
    return to_table(spark, SB.activity_sessions(replay(spark, rows, "event_time"), "user_id", "4 hours"))


@query(
    "t13_sliding_bars",
    with_ctes(
        T,
        """w AS (SELECT instrument, time_bucket(INTERVAL 1 HOUR, event_time, TIMESTAMP '1970-01-01') - to_hours(k) AS start, price FROM ticks, range(3) r(k)), wm AS (SELECT epoch_ms(max(event_time)) - 600000 AS ms FROM ticks),
           a AS (SELECT instrument, start, start + INTERVAL 3 HOUR AS "end", max(price) AS high, min(price) AS low, count(*) AS event_count FROM w GROUP BY 1, 2)""",
        select='SELECT instrument, start, "end", high, low, event_count FROM a, wm WHERE epoch_ms("end") <= ms',
    ),
)
def t13_sliding_bars(spark, sf):
    return to_table(spark, SB.sliding_bars(replay(spark, I.ticks(spark, sf), "event_time"), 3 * 3600, 3600))


class _Appending:
    """A consumer that appends what it gets, so that a batch taken twice would show; one batch fails the first time."""

    def __init__(self, path: str, fails_once_in: int | None = None):
        self.path, self.fails_once_in = path, fails_once_in

    def consume(self, signals, batch_id):
        if batch_id == self.fails_once_in:
            self.fails_once_in = None
            raise RuntimeError("consumer not reachable")
        signals.write.mode("append").parquet(self.path)


@query(
    "f3_consumers_replayed_alone",
    """SELECT consumer, event_type AS instrument, count(*) AS rows, count(DISTINCT event_id) AS events, round(sum(value), 4) AS total
       FROM events, (VALUES ('steady'), ('failing')) c(consumer) GROUP BY ALL""",
)
def f3_consumers_replayed_alone(spark, sf):
    """Two consumers of one stream; one fails in the third micro-batch, and only it gets that batch again."""
    from pyspark.errors import StreamingQueryException

    from tickloom.plugins import fan_out_committed
    from tickloom.sources.commits import CommitLog

    root = scratch_path(spark, "consumers")
    rows = I.table(spark, sf, "events").select(F.col("event_type").alias("instrument"), "event_id", "value", F.col("ts").cast("timestamp").alias("event_time"))
    stream = replay(spark, rows, "event_time")
    consumers = {"steady": _Appending(f"{root}/steady"), "failing": _Appending(f"{root}/failing", 2)}
    each = fan_out_committed(consumers, {n: CommitLog(spark, f"{root}/log-{n}") for n in consumers})
    try:
        run_available(stream, f"{root}/checkpoint", each=each)
    except StreamingQueryException:
        run_available(stream, f"{root}/checkpoint", each=each)
    taken = [spark.read.schema(rows.schema).parquet(c.path).withColumn("consumer", F.lit(n)) for n, c in consumers.items()]
    return taken[0].unionByName(taken[1]).groupBy("consumer", "instrument").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("events"), F.round(F.sum("value"), 4).alias("total")
    )
