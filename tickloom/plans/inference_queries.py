"""Queries over Sharpe measures, bootstrap, evidence and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import day_block
from tickloom.functions.statistics import expected_max_normal
from tickloom.operators import inference as S
from tickloom.operators import ledger as L
from tickloom.plans import inputs as I
from tickloom.plans.inputs import SQL, with_ctes
from tickloom.plans.ledger_queries import CLOSED, DAILY, daily
from tickloom.plans.registry import query, rnd, text_list
from tickloom.session import pin

LED = SQL["ledger"]

# Simpson's rule for the normal integral, 2000 steps, as a scalar of the column z.
PHI = """(0.5 + 0.3989422804014327 * z / 6000 * list_sum(list_transform(range(2001), lambda i:
   CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(z * i / 2000) * (z * i / 2000) / 2))))"""


def sql_moments(source: str, key: str, value: str) -> str:
    return f"""m0 AS (SELECT {key}, {value}::DOUBLE AS x FROM {source} WHERE {value} IS NOT NULL),
      m1 AS (SELECT {key}, count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM m0 GROUP BY 1),
      mom AS (SELECT {key}, any_value(n) AS n, any_value(mu) AS mu, any_value(sd) AS sd, avg(pow((x - mu) / sd, 3)) AS skew, avg(pow((x - mu) / sd, 4)) AS kurt,
        any_value(mu / sd) AS sr FROM m0 JOIN m1 USING ({key}) GROUP BY 1)"""


@query(
    "a25_probabilistic_sharpe",
    with_ctes(
        LED, CLOSED, DAILY, sql_moments("daily", "variant", "known_net"),
        "zz AS (SELECT *, (sr - 0.01) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM mom)",
        select=f"""SELECT variant, n, round(sr, 6) AS sharpe, round(skew, 6) AS skew, round(kurt, 6) AS kurtosis, round(z, 6) AS statistic, round({PHI}, 6) AS psr FROM zz""",
    ),
)
def a25_probabilistic_sharpe(spark, sf):
    out = S.probabilistic_sharpe(daily(spark, sf), ["variant"], "known_net", benchmark=0.01)
    return out.select("variant", "n", rnd("sharpe"), rnd("skew"), rnd("kurtosis"), rnd("statistic"), rnd("psr"))


@query(
    "a26_deflated_sharpe",
    with_ctes(
        LED, CLOSED,
        "td AS (SELECT instrument, close_at::DATE AS day, sum(net) AS net FROM closed WHERE net IS NOT NULL GROUP BY 1, 2)",
        sql_moments("td", "instrument", "net"),
        f"""lim AS (SELECT avg(sr) + stddev_samp(sr) * {expected_max_normal(20)!r}::DOUBLE AS t FROM mom),
        zz AS (SELECT *, (sr - t) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM mom, lim)""",
        select=f"SELECT instrument, round(t, 6) AS threshold, round(z, 6) AS statistic, round({PHI}, 6) AS dsr FROM zz",
    ),
)
def a26_deflated_sharpe(spark, sf):
    led = I.closed_trades(spark, sf).where("net IS NOT NULL")
    days = pin(led.groupBy("instrument", F.to_date("close_at").alias("day")).agg(F.sum("net").alias("net")))
    out = S.deflated_sharpe(days, "instrument", "net")
    return out.select("instrument", rnd("threshold"), rnd("statistic"), rnd("dsr"))


def sql_draw(seed: int, below: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 12))::BIGINT % ({below}))"


@query(
    "a27_daily_bootstrap",
    with_ctes(
        LED, CLOSED, DAILY,
        f"""d AS (SELECT variant, known_net::DOUBLE AS x, row_number() OVER (PARTITION BY variant ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY variant) AS n FROM daily),
         sz AS (SELECT variant, any_value(n) AS n FROM d GROUP BY 1),
         slots AS (SELECT variant, n, it, s, {sql_draw(42, "n - 5 + 1", "it", "s")} AS st FROM sz, range(250) a(it), LATERAL (SELECT unnest(range(ceil(n / 5)::BIGINT)) AS s)),
         smp AS (SELECT variant, n, it, s * 5 + o AS pos, st + o AS i FROM slots, range(5) b(o) WHERE s * 5 + o < n),
         val AS (SELECT smp.variant, it, pos, smp.n, x FROM smp JOIN d ON d.variant = smp.variant AND d.i = smp.i),
         cum AS (SELECT *, sum(x) OVER (PARTITION BY variant, it ORDER BY pos) AS eq FROM val),
         pk AS (SELECT *, greatest(max(eq) OVER (PARTITION BY variant, it ORDER BY pos), 0) AS peak FROM cum),
         stat AS (SELECT variant, it, sum(x) / any_value(n) AS mean, max(peak - eq) AS worst FROM pk GROUP BY 1, 2)""",
        select="""SELECT variant, count(*) AS iterations, round(quantile_cont(mean, 0.05), 4) AS mean_p05, round(quantile_cont(mean, 0.5), 4) AS mean_p50, round(quantile_cont(mean, 0.95), 4) AS mean_p95,
             round(quantile_cont(worst, 0.05), 2) AS drawdown_p05, round(quantile_cont(worst, 0.5), 2) AS drawdown_p50, round(quantile_cont(worst, 0.95), 2) AS drawdown_p95 FROM stat GROUP BY 1""",
    ),
)
def a27_daily_bootstrap(spark, sf):
    days = pin(daily(spark, sf))
    out = S.bootstrap_daily(days, ["variant"], "known_net", iterations=250, block_days=5, seed=42)
    return out.select("variant", "iterations", *[rnd(f"{m}_{q}", d) for m, d in (("mean", 4), ("drawdown", 2)) for q in ("p05", "p50", "p95")])


R_VALUE = "(net::DOUBLE / notional::DOUBLE)"
CANDIDATES = f"""ep AS (SELECT variant, close_at, {R_VALUE} AS r FROM closed WHERE net IS NOT NULL AND notional > 0)"""


# Draws, seed and level as the evidence rules fix them: the level is shared by 5 candidates and 2 looks.
DRAWS, SEED, ALPHA = 100_000, 20_260_913, 0.05 / (5 * 2)


def sql_blocks(width: int, name: str = "blocks", source: str = "ep") -> str:
    return f"""{name}_g AS (SELECT variant, block FROM (SELECT DISTINCT variant FROM {source}),
        LATERAL (SELECT unnest(range(ceil(date_diff('day', DATE '1970-01-01', (SELECT min(close_at::DATE) FROM {source})) / {width})::BIGINT, floor((date_diff('day', DATE '1970-01-01', (SELECT max(close_at::DATE) FROM {source})) + 1) / {width})::BIGINT)) AS block)),
      {name}_s AS (SELECT variant, floor(date_diff('day', DATE '1970-01-01', close_at::DATE) / {width})::BIGINT AS block, sum(r) AS total, count(*) AS episodes FROM {source} GROUP BY 1, 2),
      {name} AS (SELECT variant, block, coalesce(total, 0) AS total, coalesce(episodes, 0) AS episodes FROM {name}_g LEFT JOIN {name}_s USING (variant, block))"""


def episodes(spark, sf):
    """Net per unit of notional of all closed trades, as candidate episodes."""
    led = I.closed_trades(spark, sf).where("net IS NOT NULL AND notional > 0")
    return led.select("variant", "close_at", (F.col("net").cast("double") / F.col("notional").cast("double")).alias("r"))


@query(
    "a28_calendar_blocks",
    with_ctes(LED, CLOSED, CANDIDATES, sql_blocks(14), select="SELECT variant, block, round(total, 6) AS total, episodes FROM blocks"),
)
def a28_calendar_blocks(spark, sf):
    out = S.calendar_blocks(episodes(spark, sf), ["variant"], "r", "close_at", width=14)
    return out.select("variant", "block", rnd("total"), "episodes")


def sql_ratio(seed: int, iterations: int, alpha: float, source: str = "blocks") -> str:
    return f"""rb_i AS (SELECT variant, total, episodes, row_number() OVER (PARTITION BY variant ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY variant) AS n FROM {source}),
      rb_n AS (SELECT variant, any_value(n) AS n, count(*) FILTER (episodes = 0) AS zero_blocks, sum(total) / sum(episodes) AS mean, sum(episodes)::BIGINT AS episodes FROM rb_i GROUP BY 1),
      rb_s AS (SELECT n, it, {sql_draw(seed, "n", "it", "s")} AS i FROM (SELECT DISTINCT n FROM rb_n), range({iterations}) a(it), LATERAL (SELECT unnest(range(n)) AS s)),
      rb_r AS (SELECT b.variant, it, sum(total) AS t, sum(episodes) AS c FROM rb_s s JOIN rb_i b ON b.n = s.n AND b.i = s.i GROUP BY 1, 2),
      rb AS (SELECT variant, quantile_cont(t / c, {alpha}) AS lower_bound, count(*) AS resamples FROM rb_r WHERE c > 0 GROUP BY 1)"""


RATIO_SELECT = """SELECT variant, n AS blocks, zero_blocks, rb_n.episodes, round(mean, 6) AS mean, round(lower_bound, 6) AS lower_bound, coalesce(resamples, 0) AS resamples,
    CASE WHEN lower_bound IS NULL THEN 'NOT_ASSESSED' ELSE 'ASSESSED' END AS status FROM rb_n LEFT JOIN rb USING (variant)"""


@query(
    "a29_ratio_bootstrap",
    with_ctes(LED, CLOSED, CANDIDATES, sql_blocks(14), sql_ratio(SEED + 14, DRAWS, ALPHA), select=RATIO_SELECT),
)
def a29_ratio_bootstrap(spark, sf):
    blocks = pin(S.calendar_blocks(episodes(spark, sf), ["variant"], "r", "close_at", width=14))
    out = S.ratio_bootstrap(blocks, ["variant"], iterations=DRAWS, seed=SEED + 14, alpha=ALPHA)
    return out.select("variant", F.col("blocks").cast("bigint").alias("blocks"), F.col("zero_blocks").cast("bigint").alias("zero_blocks"), "episodes", rnd("mean"), rnd("lower_bound"), "resamples", "status")


@query(
    "a30_joint_aligned_bootstrap",
    with_ctes(
        LED, CLOSED, CANDIDATES, sql_blocks(28, "all_blocks"),
        """blocks AS (SELECT * FROM all_blocks WHERE block IN (SELECT block FROM all_blocks GROUP BY 1 HAVING count(DISTINCT variant) = (SELECT count(DISTINCT variant) FROM all_blocks)))""",
        sql_ratio(SEED + 28, DRAWS, ALPHA), select=RATIO_SELECT,
    ),
)
def a30_joint_aligned_bootstrap(spark, sf):
    blocks = S.calendar_blocks(episodes(spark, sf), ["variant"], "r", "close_at", width=28)
    shared = pin(S.aligned(pin(blocks), "variant"))  # a block without episodes is a block
    out = S.ratio_bootstrap(shared, ["variant"], iterations=DRAWS, seed=SEED + 28, alpha=ALPHA)
    return out.select("variant", F.col("blocks").cast("bigint").alias("blocks"), F.col("zero_blocks").cast("bigint").alias("zero_blocks"), "episodes", rnd("mean"), rnd("lower_bound"), "resamples", "status")


STRESS = "((net - cost)::DOUBLE / notional::DOUBLE)"  # every cost is paid twice


@query(
    "a39_candidate_evidence",
    with_ctes(
        LED, CLOSED, CANDIDATES, sql_blocks(14), sql_ratio(SEED + 14, DRAWS, ALPHA),
        f"sep AS (SELECT variant, close_at, {STRESS} AS r FROM closed WHERE net IS NOT NULL AND cost IS NOT NULL AND notional > 0)",
        sql_blocks(14, "s_blocks", "sep"), sql_ratio(SEED + 14, DRAWS, ALPHA, "s_blocks").replace("rb_", "sb_").replace("rb AS", "sb AS"),
        """facts AS (SELECT variant, count(*) FILTER (cost IS NULL) AS unknown_costs, count(*) FILTER (notional IS NULL OR notional <= 0) AS invalid_r, sum(notional)::DOUBLE AS notional FROM closed GROUP BY 1),
           best AS (SELECT variant, sum(net) FILTER (rn > 5)::DOUBLE AS drop_best FROM (SELECT variant, net, row_number() OVER (PARTITION BY variant ORDER BY net DESC) AS rn FROM closed WHERE net IS NOT NULL) GROUP BY 1),
           dn AS (SELECT variant, sum(r) OVER (PARTITION BY variant ORDER BY day) AS eq, day FROM (SELECT variant, close_at::DATE AS day, sum((net - cost)::DOUBLE) AS r FROM closed WHERE net IS NOT NULL AND cost IS NOT NULL GROUP BY 1, 2)),
           dp AS (SELECT variant, greatest(max(eq) OVER (PARTITION BY variant ORDER BY day), 0) - eq AS dd FROM dn),
           mdd AS (SELECT variant, max(dd) AS worst FROM dp GROUP BY 1),
           j AS (SELECT n.variant AS candidate, s.mean, rb.lower_bound AS base_bound, sb.lower_bound AS stress_bound, worst / notional AS drawdown, n.episodes, n.n AS blocks, unknown_costs, invalid_r, drop_best
             FROM rb_n n JOIN rb USING (variant) JOIN sb_n s USING (variant) JOIN sb USING (variant) JOIN mdd USING (variant) JOIN facts USING (variant) JOIN best USING (variant)),
           g AS (SELECT *, CASE WHEN invalid_r > 0 THEN 'INVALID' WHEN unknown_costs > 0 OR episodes < 100 OR blocks < 8 THEN 'INSUFFICIENT'
             WHEN mean < 0.05 OR base_bound <= 0 OR stress_bound <= 0 OR drawdown > 0.1 OR drop_best < 0 THEN 'REJECT' ELSE 'ACCEPT' END AS decision FROM j)""",
        select="""SELECT candidate, decision, round(mean, 6) AS mean_r, round(base_bound, 6) AS base_bound, round(stress_bound, 6) AS stress_bound, round(drawdown, 6) AS drawdown, round(drop_best, 2) AS drop_best, unknown_costs, invalid_r,
            row_number() OVER (ORDER BY CASE decision WHEN 'ACCEPT' THEN 0 WHEN 'REJECT' THEN 1 WHEN 'INVALID' THEN 2 ELSE 3 END, drawdown, unknown_costs > 0, stress_bound DESC, candidate) AS position FROM g""",
    ),
)
def a39_candidate_evidence(spark, sf):
    led = pin(I.closed_trades(spark, sf).select("trade_id", "variant", "close_at", "net", "cost", "notional"))
    stressed = led.where("net IS NOT NULL AND cost IS NOT NULL")
    stress = stressed.where("notional > 0").select("variant", "close_at", ((F.col("net") - F.col("cost")).cast("double") / F.col("notional").cast("double")).alias("r"))

    def bounds(eps):
        blocks = pin(S.calendar_blocks(pin(eps), ["variant"], "r", "close_at", width=14))
        return S.ratio_bootstrap(blocks, ["variant"], iterations=DRAWS, seed=SEED + 14, alpha=ALPHA)

    base = bounds(episodes(spark, sf)).select("variant", "episodes", "blocks", F.col("lower_bound").alias("base_bound"))
    under = bounds(stress).select("variant", F.col("mean").alias("mean_r"), F.col("lower_bound").alias("stress_bound"))
    days = stressed.groupBy("variant", F.date_trunc("day", "close_at").alias("day")).agg(F.sum((F.col("net") - F.col("cost")).cast("double")).alias("x"))
    worst = L.drawdown_summary(L.equity_curve(days, ["variant"], ["day"], "x", "day"), ["variant"], ["day"], "day").select("variant", "max_drawdown")
    facts = led.groupBy("variant").agg(
        F.count_if(F.col("cost").isNull()).alias("unknown_costs"), F.count_if(F.col("notional").isNull() | (F.col("notional") <= 0)).alias("invalid_r"), F.sum("notional").cast("double").alias("notional"),
    )
    best = L.drop_best(led, ["variant"], "net", "trade_id", 5).select("variant", F.col("without_best").cast("double").alias("drop_best"))
    rows = base.join(under, "variant").join(worst, "variant").join(facts, "variant").join(best, "variant")
    rows = rows.withColumn("drawdown", F.col("max_drawdown") / F.col("notional")).withColumnRenamed("variant", "candidate")
    out = S.evidence(rows)
    return out.select(
        "candidate", "decision", rnd("mean_r"), rnd("base_bound"), rnd("stress_bound"), rnd("drawdown"), rnd("drop_best", 2), "unknown_costs", "invalid_r", F.col("position").cast("bigint").alias("position"),
    )


@query(
    "w13_cusum_monitor",
    with_ctes(
        LED, CLOSED, CANDIDATES,
        """dd AS (SELECT variant, close_at::DATE AS day, sum(r) AS x FROM ep GROUP BY 1, 2),
           num AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY day) AS rn FROM dd),
           fold AS (SELECT variant, rn, day, least(0.0::DOUBLE, x - 1.2::DOUBLE + 0.1::DOUBLE) AS c FROM num WHERE rn = 1
             UNION ALL SELECT n.variant, n.rn, n.day, least(0.0::DOUBLE, f.c + n.x - 1.2::DOUBLE + 0.1::DOUBLE) FROM fold f JOIN num n ON n.variant = f.variant AND n.rn = f.rn + 1)""",
        select="""SELECT variant, round(min(c), 6) AS lowest, min(CASE WHEN -c >= 5 THEN day END)::TIMESTAMP AS breach_at, count(*) AS sessions,
            CASE WHEN count(*) < 30 THEN 'OBSERVE_INSUFFICIENT_SAMPLE' WHEN count(*) < 5000 THEN 'INTERIM_REVIEW' ELSE 'FINAL_REVIEW' END AS state FROM fold GROUP BY 1""",
    ),
)
def w13_cusum_monitor(spark, sf):
    days = episodes(spark, sf).groupBy("variant", F.to_date("close_at").alias("day")).agg(F.sum("r").alias("x"))
    rows = S.cusum(days, ["variant"], "x", reference=1.2, allowance=0.1, threshold=5.0)
    out = rows.groupBy("variant").agg(
        F.round(F.min("cusum"), 6).alias("lowest"), F.min(F.when(F.col("breach"), F.col("day"))).cast("timestamp").alias("breach_at"),
        F.count(F.lit(1)).alias("sessions"), F.count_distinct(day_block("day", 14)).alias("blocks"),
    )
    state = S.review_state(F.col("sessions"), F.col("sessions"), F.col("blocks"), interim=30, final=5000, min_sessions=60, min_blocks=8)
    return out.withColumn("state", state).drop("blocks")
