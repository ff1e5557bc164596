"""Interval questions over a quote history without pairing trades with quotes.

A block index holds a key's quotes in time order: blocks of ``BLOCK`` instants with their extreme prices, and above
them a tree whose nodes hold the extremes of ``FAN`` nodes each, one row per block and node. An interval is two edge
blocks and a few runs of whole nodes, so extremes over a holding period are an equality join with that many rows.
A first touch is the first of these pieces that reaches the level, followed down the tree to the instant. The rows
per trade grow with the logarithm of the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.scan import CHUNK, range_chunks, run_max, run_sum, running
from tickloom.session import pin

BLOCK, FAN = 256, 64
# Nodes are read by many trades: they are repeated so often, and the trades spread over the copies.
COPIES = 16
SERIES = ("bid_up", "bid_down", "ask_up", "ask_down")
_PIECE = "array<struct<ord:int,level:int,node:bigint,lo:bigint,hi:bigint>>"


def _signed(bid: str, ask: str) -> dict[str, Column]:
    return {"bid_up": F.col(bid), "bid_down": -F.col(bid), "ask_up": F.col(ask), "ask_down": -F.col(ask)}


class BlockIndex:
    """Rows (key, level, node, copy, items): ``items`` are the instants of a block (level 0) or the children of a node.

    An item is (at, extremes): ``at`` is an instant in microseconds, or a child's number. Quotes of one instant are one
    item, so the order needs no tie-break; a missing price reaches nothing.
    """

    def __init__(self, quotes: DataFrame, key: Sequence[str] = ("instrument",), *, at: str = "event_time", bid: str = "bid", ask: str = "ask"):
        self.key = key = list(key)
        instants = quotes.groupBy(*key, F.unix_micros(at).alias("at")).agg(*[F.max(c).alias(n) for n, c in _signed(bid, ask).items()])
        chunked = range_chunks(instants.where(F.col("at").isNotNull()), key, ["at"])
        by = [*key, CHUNK]
        place = F.row_number().over(Window.partitionBy(*by).orderBy("at")) - 1
        blocks = chunked.withColumn("_b", F.floor(place / BLOCK)).groupBy(*by, "_b").agg(F.array_sort(F.collect_list(F.struct("at", *SERIES))).alias("items"))
        counts = chunked.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
        earlier = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        offset = counts.select(*by, F.coalesce(F.sum("_blocks").over(earlier), F.lit(0)).alias("_before"))
        node = (F.col("_before") + F.col("_b")).cast("bigint")
        levels = [pin(blocks.join(offset, by).select(*key, F.lit(0).alias("level"), node.alias("node"), "items"))]
        self.starts = levels[0].select(*key, F.col("items")[0]["at"].alias("at"), "node")
        last = self.starts.agg(F.max("node")).first()[0] or 0
        while last > 0 or len(levels) == 1:
            child = levels[-1].select(*key, F.col("node").alias("at"), *[F.array_max(F.col("items")[s]).alias(s) for s in SERIES])
            up = child.groupBy(*key, F.floor(F.col("at") / FAN).cast("bigint").alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", *SERIES))).alias("items"))
            levels.append(pin(up.select(*key, F.lit(len(levels)).alias("level"), "node", "items")))
            last //= FAN
        self.height = len(levels) - 1
        self.levels = levels

    def rows(self, level: int) -> DataFrame:
        copy = F.lit(0) if level == 0 else F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
        return self.levels[level].select(*self.key, "level", "node", copy.alias("copy"), "items")

    def all_rows(self) -> DataFrame:
        out = self.rows(0)
        for level in range(1, self.height + 1):
            out = out.unionByName(self.rows(level))
        return out

    def locate(self, spans: DataFrame) -> DataFrame:
        """Spans (key, _s, _e) with the blocks _bs and _be that their ends fall in; those that end before all quotes drop out."""
        ends = F.array(F.struct(F.col("_s").alias("at"), F.lit(1).alias("side")), F.struct(F.col("_e").alias("at"), F.lit(2).alias("side")))
        probes = spans.select(*self.key, "_s", "_e", F.explode(ends).alias("_p")).select(*self.key, "_s", "_e", "_p.*")
        both = self.starts.withColumn("side", F.lit(0)).unionByName(probes, allowMissingColumns=True)
        order = ["at", "side", "_s", "_e"]
        found = running(range_chunks(both, self.key, order), self.key, order, {"_node": run_max("node")}).where("side > 0")
        by_side = [F.max(F.when(F.col("side") == k, F.col("_node"))).alias(n) for k, n in ((1, "_bs"), (2, "_be"))]
        placed = found.groupBy(*self.key, "_s", "_e").agg(*by_side).where("_be is not null")
        return placed.withColumn("_bs", F.coalesce("_bs", F.lit(0).cast("bigint")))

    def pieces(self, placed: DataFrame) -> DataFrame:
        """Each span once per block or node it needs: ord (in time), level, node and the items lo to hi that count."""
        piece = lambda ord_, level, node, lo, hi: F.array(F.struct(F.lit(ord_).alias("ord"), F.lit(level).alias("level"), node.alias("node"), lo.alias("lo"), hi.alias("hi")))
        none, s, e, bs, be = F.array().cast(_PIECE), F.col("_s"), F.col("_e"), F.col("_bs"), F.col("_be")
        top = 2 * self.height + 2
        parts = [piece(0, 0, bs, s, e), F.when(be > bs, piece(top, 0, be, s, e)).otherwise(none)]
        out = placed.withColumns({"_lo1": bs + 1, "_hi1": be - 1})
        for k in range(1, self.height + 1):
            lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
            left, right = F.floor(lo / FAN).cast("bigint"), F.floor(hi / FAN).cast("bigint")
            two = F.concat(piece(k, k, left, lo, (left + 1) * FAN - 1), piece(top - k, k, right, right * FAN, hi))
            parts.append(F.when(lo > hi, none).when(left == right, piece(k, k, left, lo, hi)).otherwise(two))
            out = out.withColumns({f"_lo{k + 1}": F.when(lo <= hi, left + 1).otherwise(1), f"_hi{k + 1}": F.when(lo <= hi, right - 1).otherwise(0)})
        spread = out.withColumn("_c", F.explode(F.concat(*parts)))
        return spread.select(*placed.columns, "_c.*").withColumn("copy", self._copy())

    def _copy(self) -> Column:
        return F.when(F.col("level") == 0, 0).otherwise(F.pmod(F.xxhash64("_s", "_e"), F.lit(COPIES)).cast("int"))


def _inside(x: Column) -> Column:
    return (x["at"] >= F.col("lo")) & (x["at"] <= F.col("hi"))


def extremes(
    intervals: DataFrame, quotes: DataFrame, ident: Sequence[str], *, start: str, end: str,
    key: Sequence[str] = ("instrument",),
) -> DataFrame:
    """Highest and lowest bid and ask of the quotes inside each closed interval; an interval without a quote has no row."""
    key, ident = list(key), list(ident)
    index = BlockIndex(quotes, key)
    spans = intervals.select(*key, *ident, F.unix_micros(start).alias("_s"), F.unix_micros(end).alias("_e")).where("_s <= _e")
    pieces = index.pieces(index.locate(spans.select(*key, "_s", "_e").distinct()))
    read = pieces.join(index.all_rows(), [*key, "level", "node", "copy"]).withColumn("items", F.filter("items", _inside)).where(F.size("items") > 0)
    best = [F.max(F.array_max(F.col("items")[s])).alias(s) for s in SERIES]
    out = spans.join(read.groupBy(*key, "_s", "_e").agg(*best), [*key, "_s", "_e"])
    return out.select(
        *ident, F.col("bid_up").alias("bid_max"), (-F.col("bid_down")).alias("bid_min"),
        F.col("ask_up").alias("ask_max"), (-F.col("ask_down")).alias("ask_min"),
    )


def excursions(
    trades: DataFrame, quotes: DataFrame, ident: str, *, entry: str = "entry_at", close: str = "close_at", entry_price: str = "entry_price",
    start_mfe: str | None = None, start_mae: str | None = None,
) -> DataFrame:
    """Most favourable and most adverse move of each trade: ident, mfe, mae.

    A long is valued at the bid, a short at the ask. ``start_mfe`` and ``start_mae`` name values known before (an earlier part of
    the trade): quotes only widen them, and a trade without quotes keeps them. Without them such a trade has no row.
    """
    found = extremes(trades, quotes, [ident], start=entry, end=close)
    rows = trades.join(found, ident, "left")
    up, e = F.col("direction") == "UP", F.col(entry_price)
    best, worst = F.when(up, F.col("bid_max") - e).otherwise(e - F.col("ask_min")), F.when(up, F.col("bid_min") - e).otherwise(e - F.col("ask_max"))
    mfe = F.greatest(best, F.col(start_mfe)) if start_mfe else best
    mae = F.least(worst, F.col(start_mae)) if start_mae else worst
    return rows.select(ident, mfe.alias("mfe"), mae.alias("mae")).where("mfe is not null or mae is not null")


def _first_item() -> Column:
    """The first item in lo..hi whose series reaches the threshold."""
    def reaches(x: Column) -> Column:
        value = F.when(F.col("series") == SERIES[0], x[SERIES[0]])
        for s in SERIES[1:]:
            value = value.when(F.col("series") == s, x[s])
        return _inside(x) & (value >= F.col("threshold"))

    return F.get(F.filter("items", reaches), F.lit(0))["at"]


def first_reach(
    barriers: DataFrame, quotes: DataFrame, ident: Sequence[str], *, start_us: str, end_us: str,
    key: Sequence[str] = ("instrument",),
) -> DataFrame:
    """First instant in [start_us, end_us] at which a price series reaches a threshold.

    ``barriers``: key columns, ident columns, series (one of ``SERIES``; a *_down series is
    the negated price), threshold, and the two bounds. Result: ident, series, touch_us.
    """
    key = list(key)
    index = BlockIndex(quotes, key)
    carried = [*key, *ident, "series", "threshold", "_s", "_e"]
    wanted = barriers.withColumns({"_s": F.col(start_us), "_e": F.col(end_us)}).where("_s <= _e and threshold is not null").select(*carried)
    placed = wanted.join(index.locate(wanted.select(*key, "_s", "_e").distinct()), [*key, "_s", "_e"])
    at = [*key, "level", "node", "copy"]
    touched = index.pieces(placed).join(index.all_rows(), at).withColumn("hit", _first_item()).where("hit is not null")
    first = touched.groupBy(*carried).agg(F.min_by(F.struct("level", "hit"), "ord").alias("_f"))
    rows = pin(first.select(*carried, "_f.level", "_f.hit"))
    for level in range(index.height - 1, -1, -1):
        open_ = rows.where(F.col("level") > level).select(*carried, F.lit(level).alias("level"), F.col("hit").alias("node"))
        # The whole node lies inside the interval.
        open_ = open_.withColumns({"copy": index._copy(), "lo": F.lit(-(1 << 63)).cast("bigint"), "hi": F.lit((1 << 63) - 1).cast("bigint")})
        lower = open_.join(index.rows(level), at).withColumn("hit", _first_item()).select(*carried, "level", "hit")
        rows = pin(rows.where(F.col("level") <= level).unionByName(lower))
    return rows.select(*ident, "series", F.col("hit").alias("touch_us"))


# ---- level at an instant --------------------------------------------------


def signed_events(trades: DataFrame, amounts: dict[str, Column], *, key: Sequence[str], entry: str, close: str) -> DataFrame:
    """Trades as +amounts at the entry and −amounts at the close, summed per instant; one row per key and instant."""
    names = list(amounts)
    ends = F.array(
        F.struct(F.col(entry).alias("at"), *[amounts[n].alias(n) for n in names]),
        F.struct(F.col(close).alias("at"), *[(-amounts[n]).alias(n) for n in names]),
    )
    each = trades.withColumn("_e", F.explode(ends)).select(*key, "_e.*").where(F.col("at").isNotNull())
    return each.groupBy(*key, "at").agg(*[F.sum(n).alias(n) for n in names])


def level_at(
    trades: DataFrame, marks: DataFrame, amounts: dict[str, Column], *, key: Sequence[str], entry: str, close: str,
    mark_at: str, mark_id: str,
) -> DataFrame:
    """Sum of ``amounts`` over the trades open at each mark: entry ≤ mark < close.

    Signed sums per instant, made before the shuffle, merged with the marks and summed as they come; trades and marks are
    never paired. A mark follows all that happens at its instant.
    """
    names = list(amounts)
    events = signed_events(trades, amounts, key=key, entry=entry, close=close).withColumns({"kind": F.lit(0), "ident": F.lit("")})
    probes = marks.select(
        *key, F.col(mark_at).alias("at"), F.lit(1).alias("kind"), F.col(mark_id).cast("string").alias("ident"),
        F.struct(*marks.columns).alias("_mark"),
    )
    both = events.unionByName(probes, allowMissingColumns=True)
    order = ["at", "kind", "ident"]
    summed = running(range_chunks(both, key, order), key, order, {f"open_{n}": run_sum(n) for n in names})
    return summed.where(F.col("kind") == 1).select("_mark.*", *[f"open_{n}" for n in names])
