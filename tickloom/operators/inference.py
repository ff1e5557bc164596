"""Sharpe-type measures, block bootstrap and candidate evidence.

Rows are reduced to one value per day or calendar block first, so the arrays below have
one element per day or block of the covered span. The resampling iterations are what is
spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import codes, day_block
from tickloom.functions.statistics import draw, expected_max_normal, normal_cdf, psr_statistic
from tickloom.session import pin, shuffle_width


def moments(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, population deviation, skewness, raw kurtosis and Sharpe ratio per key."""
    x = F.col(value).cast("double")
    out = rows.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"),
        (F.kurtosis(x) + 3.0).alias("kurtosis"),
    )
    varies = (F.col("n") >= 2) & (F.col("sd") > 0)
    return out.withColumn("sharpe", F.when(varies, F.col("mean") / F.col("sd")))


def probabilistic_sharpe(rows: DataFrame, keys: Sequence[str], value: str, benchmark: float = 0.0) -> DataFrame:
    m = moments(rows, keys, value)
    z = psr_statistic("sharpe", F.lit(benchmark), "n", "skew", "kurtosis")
    return m.withColumn("statistic", z).withColumn("psr", normal_cdf("statistic"))


def deflated_sharpe(rows: DataFrame, trial: str, value: str, *, registered: int | None = None) -> DataFrame:
    """Per trial: the probability that its Sharpe beats the best of N lucky trials.

    N is the number of registered trials; by default the trials present in ``rows``.
    """
    m = moments(rows, [trial], value)
    pool = m.agg(F.avg("sharpe"), F.stddev_samp("sharpe"), F.count(F.lit(1))).first()  # three numbers
    centre, spread, present = pool[0] or 0.0, pool[1] or 0.0, pool[2]
    limit = centre + spread * expected_max_normal(registered or present)
    out = m.withColumn("threshold", F.lit(float(limit)))
    out = out.withColumn("statistic", psr_statistic("sharpe", "threshold", "n", "skew", "kurtosis"))
    return out.withColumn("dsr", normal_cdf("statistic"))


TILE_VALUES = 50_000  # numbers of all the keys that are resampled together


def _series(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """One row per key with its daily or block values as an array in order."""
    packed = F.array_sort(F.collect_list(F.struct(order, *[F.col(f).cast("double").alias(f) for f in fields])))
    return rows.groupBy(*keys).agg(packed.alias("_s")).withColumn("_n", F.size("_s"))


def _iterate(series: DataFrame, keys: Sequence[str], iterations: int) -> DataFrame:
    """Each key once per iteration, spread evenly over the tasks.

    The arrays travel once per batch of iterations, not once per iteration.
    """
    width = shuffle_width(series.sparkSession)
    batches = min(iterations, 4 * width)
    spread = series.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    spread = spread.repartition(width, *keys, "_batch")
    turns = F.explode(F.sequence(F.col("_batch"), F.lit(iterations - 1), F.lit(batches)))
    return spread.withColumn("iteration", turns).drop("_batch")


def bootstrap_daily(
    days: DataFrame, keys: Sequence[str], value: str, *, day: str = "day", iterations: int = 250, block_days: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Moving-block bootstrap of daily results: quantiles of the mean and of the drawdown."""
    series = _series(days, keys, day, [value]).where(F.col("_n") >= 4)
    width = F.least(F.lit(block_days), F.col("_n"))
    rows = _iterate(series.withColumn("_w", width), keys, iterations)
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("_w")).cast("int") - 1),
        lambda slot: F.slice(
            F.col("_s"), draw(seed, F.col("iteration"), slot, below=F.col("_n") - F.col("_w") + 1).cast("int") + 1, F.col("_w")
        ),
    )
    sample = F.slice(F.transform(F.flatten(blocks), lambda s: s[value]), F.lit(1), F.col("_n"))
    rows = rows.select(*keys, "iteration", "_n", sample.alias("_x"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("eq"), zero.alias("peak"), zero.alias("worst"))

    def advance(acc: Column, x: Column) -> Column:
        eq = acc["eq"] + x
        peak = F.greatest(acc["peak"], eq)
        return F.struct(eq.alias("eq"), peak.alias("peak"), F.greatest(acc["worst"], peak - eq).alias("worst"))

    walked = rows.withColumn("_a", F.aggregate("_x", start, advance))
    per = walked.select(*keys, (F.col("_a.eq") / F.col("_n")).alias("mean"), F.col("_a.worst").alias("worst"))
    pct = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    out = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("iterations"), F.percentile("mean", pct).alias("_m"), F.percentile("worst", pct).alias("_d")
    )
    names = ("p05", "p50", "p95")
    return out.select(
        *keys, "iterations", *[F.col("_m")[i].alias(f"mean_{q}") for i, q in enumerate(names)],
        *[F.col("_d")[i].alias(f"drawdown_{q}") for i, q in enumerate(names)],
    )


def calendar_blocks(episodes: DataFrame, keys: Sequence[str], value: str, at: str, *, width: int, coverage: tuple[str, str] | None = None) -> DataFrame:
    """Sum and count per whole calendar block of the covered span; empty blocks are kept.

    ``coverage`` names the first and the last covered day; without it they are those of the episodes.
    """
    if coverage is None:
        coverage = episodes.agg(F.min(F.to_date(at)), F.max(F.to_date(at))).first()
    first, last = F.lit(coverage[0]).cast("date"), F.lit(coverage[1]).cast("date")
    lo = F.ceil(F.datediff(first, F.lit("1970-01-01").cast("date")) / F.lit(width))
    hi = F.floor((F.datediff(last, F.lit("1970-01-01").cast("date")) + 1) / F.lit(width)) - 1
    grid = episodes.select(*keys).distinct().withColumn("block", F.explode(F.sequence(lo, hi)))
    sums = episodes.where(F.col(value).isNotNull()).groupBy(*keys, day_block(F.to_date(at), width).alias("block")).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("episodes")
    )
    return grid.join(sums, [*keys, "block"], "left").select(
        *keys, "block", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("episodes", F.lit(0)).alias("episodes")
    )


def ratio_bootstrap(
    blocks: DataFrame, keys: Sequence[str], *, iterations: int, seed: int, alpha: float,
) -> DataFrame:
    """Resample whole blocks; mean Σ value / Σ episodes and its one-sided lower bound.

    The drawn indexes depend on seed, iteration and slot only, so keys with the same
    blocks share one schedule and their bounds are comparable. ``status`` is NOT_ASSESSED, without a bound, for a key
    with fewer than two blocks or without an episode in any resample.
    """
    series = _series(blocks, keys, "block", ["total", "episodes"])
    point = series.withColumns({
        "blocks": F.col("_n"), "_tot": F.aggregate("_s", F.lit(0.0), lambda a, s: a + s["total"]),
        "_cnt": F.aggregate("_s", F.lit(0.0), lambda a, s: a + s["episodes"]),
        "zero_blocks": F.size(F.filter("_s", lambda s: s["episodes"] == 0)),
    })
    # One schedule serves all keys with as many blocks: its indexes are drawn once, written down, and applied to tiles of keys.
    many = series.where(F.col("_n") >= 2)
    alike = many.groupBy("_n").agg(F.ceil(F.count(F.lit(1)) * F.col("_n") / TILE_VALUES).alias("_tiles"))
    tile = F.pmod(F.xxhash64(*keys), F.col("_tiles"))
    tiles = many.join(alike, "_n").withColumn("_tile", tile).groupBy("_n", "_tile").agg(F.collect_list(F.struct(*keys, "_s")).alias("_k"))
    slots = F.sequence(F.lit(0), F.col("_n") - 1)
    picks = F.transform(slots, lambda slot: draw(seed, F.col("iteration"), slot, below=F.col("_n")).cast("int"))
    drawn = pin(_iterate(alike.select("_n"), ["_n"], iterations).select("_n", "iteration", picks.alias("_p")))
    copies = 4 * shuffle_width(series.sparkSession)
    spread = tiles.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    # The rows are few bytes but much work: a given number of partitions is not merged into fewer.
    dealt = drawn.withColumn("_salt", F.pmod(F.col("iteration"), F.lit(copies)).cast("int")).repartition(copies, "_n", "_salt")
    rows = dealt.join(spread, ["_n", "_salt"])
    applied = rows.select("_p", F.explode("_k").alias("_k")).select("_k.*", "_p").select(
        *keys, F.aggregate("_p", F.lit(0.0), lambda a, i: a + F.get("_s", i)["total"]).alias("_t"),
        F.aggregate("_p", F.lit(0.0), lambda a, i: a + F.get("_s", i)["episodes"]).alias("_c"),
    )
    ratios = applied.where(F.col("_c") > 0).groupBy(*keys).agg(
        F.percentile(F.col("_t") / F.col("_c"), F.lit(alpha)).alias("lower_bound"), F.count(F.lit(1)).alias("resamples")
    )
    out = point.select(
        *keys, "blocks", "zero_blocks", F.col("_cnt").cast("bigint").alias("episodes"), F.try_divide("_tot", "_cnt").alias("mean"),
    ).join(ratios, list(keys), "left").withColumn("resamples", F.coalesce("resamples", F.lit(0).cast("bigint")))
    return out.withColumn("status", F.when(F.col("lower_bound").isNotNull(), "ASSESSED").otherwise("NOT_ASSESSED"))


def aligned(blocks: DataFrame, candidate: str) -> DataFrame:
    """Only the blocks that every candidate has."""
    total = blocks.agg(F.count_distinct(candidate)).scalar()
    shared = blocks.groupBy("block").agg(F.count_distinct(candidate).alias("_n")).where(F.col("_n") == total)
    return blocks.join(shared.select("block"), "block", "left_semi")


def cusum(days: DataFrame, keys: Sequence[str], value: str, *, day: str = "day", reference: float = 0.0, allowance: float = 0.0, threshold: float = 5.0) -> DataFrame:
    """Downside CUSUM per day, closed form: running sum less its running maximum above zero."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumn("_s", F.sum(F.col(value).cast("double") - reference + allowance).over(w))
    rows = rows.withColumn("cusum", F.col("_s") - F.greatest(F.max("_s").over(w), F.lit(0.0)))
    return rows.withColumn("breach", -F.col("cusum") >= threshold).drop("_s")


def review_state(episodes: Column, sessions: Column, blocks: Column, *, interim: int, final: int, min_sessions: int, min_blocks: int) -> Column:
    return (
        F.when(episodes < interim, "OBSERVE_INSUFFICIENT_SAMPLE").when(episodes < final, "INTERIM_REVIEW")
        .when((sessions < min_sessions) | (blocks < min_blocks), "FINAL_REVIEW_INSUFFICIENT_SESSIONS_OR_BLOCKS")
        .otherwise("FINAL_REVIEW")
    )


@dataclass(frozen=True)
class EvidenceGates:
    min_episodes: int = 100
    min_blocks: int = 8
    min_mean_r: float = 0.05
    max_drawdown: float = 0.10


def evidence(rows: DataFrame, gates: EvidenceGates = EvidenceGates()) -> DataFrame:
    """Decision per candidate from its joined metrics, with reasons and a review order.

    ``rows``: candidate, invalid_r, unknown_costs, episodes, blocks, mean_r, base_bound,
    stress_bound, drawdown, drop_best.
    """
    missing = lambda *cs: F.greatest(*[F.col(c).isNull().cast("int") for c in cs]) == 1 if len(cs) > 1 else F.col(cs[0]).isNull()
    lacking = codes([
        ("costs_incomplete_or_unknown", F.col("unknown_costs") > 0),
        ("holdout_episodes_below_minimum", F.col("episodes") < gates.min_episodes),
        ("holdout_blocks_below_minimum", F.col("blocks") < gates.min_blocks),
        ("stress_inference_missing", missing("mean_r", "stress_bound")),
        ("base_inference_missing", missing("base_bound")),
        ("stress_drawdown_missing", missing("drawdown")),
        ("drop_best_sample_missing", missing("drop_best")),
    ])
    failing = codes([
        ("stress_mean_r_below_minimum", F.col("mean_r") < gates.min_mean_r),
        ("lcb_not_positive_base_or_stress", (F.col("stress_bound") <= 0) | (F.col("base_bound") <= 0)),
        ("stress_drawdown_above_limit", F.col("drawdown") > gates.max_drawdown),
        ("drop_best_net_negative", F.col("drop_best") < 0),
    ])
    invalid = codes([("invalid_r_rows", F.col("invalid_r") > 0)])
    out = rows.withColumns({"_bad": invalid, "_lack": lacking, "_fail": failing})
    decision = (
        F.when(F.size("_bad") > 0, "INVALID").when(F.size("_lack") > 0, "INSUFFICIENT")
        .when(F.size("_fail") > 0, "REJECT").otherwise("ACCEPT")
    )
    out = out.withColumn("decision", decision)
    reasons = F.when(F.col("decision").isin("REJECT", "ACCEPT"), F.col("_fail")).otherwise(F.concat("_bad", "_lack"))
    rank = F.when(F.col("decision") == "ACCEPT", 0).when(F.col("decision") == "REJECT", 1).when(F.col("decision") == "INVALID", 2).otherwise(3)
    queue = Window.orderBy(  # one row per candidate
        rank, F.asc_nulls_last("drawdown"), F.col("unknown_costs") > 0, F.desc_nulls_last("stress_bound"), "candidate"
    )
    return out.withColumns({"reasons": F.array_sort(reasons), "position": F.row_number().over(queue)}).drop("_bad", "_lack", "_fail")
