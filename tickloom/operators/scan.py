"""Ordered scans that stay parallel when one key holds most of the rows.

``Window.partitionBy(key).orderBy(time)`` puts every row of a key into one task. The
helpers here cut the global order (key, time, tie-break) into ranges of about equal row
count, run the window inside each range, and pass only one summary row per (key, range)
to the next range. The range bounds include the tie-break column, so neither a hot key
nor a hot instant can make a range grow.

Contract: ``keys`` are non-null, ``order`` names ascending columns that together are
unique within a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import pin, shuffle_width

CHUNK = "_chunk"


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Add ``_chunk``: the number of the range a row falls in, ascending in the order.

    The result is pinned, because the number comes from sampled range bounds and two
    reads of the plan must agree on it.
    """
    width = chunks or shuffle_width(df.sparkSession)
    return pin(df.repartitionByRange(width, *keys, *order).withColumn(CHUNK, F.spark_partition_id()))


@dataclass(frozen=True)
class Running:
    kind: str
    value: Column

    def summary(self, name: str, ordering: Column) -> Column:
        c = F.col(name)
        if self.kind == "sum":
            return F.sum(c)
        if self.kind == "count":
            return F.count(c)
        if self.kind == "max":
            return F.max(c)
        if self.kind == "min":
            return F.min(c)
        return F.max_by(c, F.when(c.isNotNull(), ordering))

    def inside(self, name: str, window) -> Column:
        c = F.col(name)
        if self.kind == "last":
            return F.last(c, ignorenulls=True).over(window)
        return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[self.kind](c).over(window)

    def across(self, name: str, window) -> Column:
        c = F.col(name)
        if self.kind == "last":
            return F.last(c, ignorenulls=True).over(window)
        return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[self.kind](c).over(window)

    def join_up(self, carried: Column, inside: Column) -> Column:
        if self.kind in ("sum", "count"):
            return F.when(carried.isNull(), inside).when(inside.isNull(), carried).otherwise(carried + inside)
        if self.kind == "max":
            return F.greatest(carried, inside)
        if self.kind == "min":
            return F.least(carried, inside)
        return F.coalesce(inside, carried)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def run_sum(value: str | Column) -> Running:
    return Running("sum", _col(value))


def run_count(value: str | Column) -> Running:
    return Running("count", _col(value))


def run_max(value: str | Column) -> Running:
    return Running("max", _col(value))


def run_min(value: str | Column) -> Running:
    return Running("min", _col(value))


def run_last(value: str | Column) -> Running:
    """Latest non-null value."""
    return Running("last", _col(value))


def running(
    chunked: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, Running],
    *,
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates from the first row of a key up to (or just before) each row."""
    by = [*keys, CHUNK]
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ordering = F.struct(*order)
    work = chunked.withColumns({f"_v_{n}": a.value for n, a in aggs.items()})
    summary = work.groupBy(*by).agg(*[a.summary(f"_v_{n}", ordering).alias(f"_s_{n}") for n, a in aggs.items()])
    carry = summary.select(*by, *[a.across(f"_s_{n}", earlier).alias(f"_c_{n}") for n, a in aggs.items()])
    inside = work.withColumns({f"_i_{n}": a.inside(f"_v_{n}", inner) for n, a in aggs.items()})
    joined = inside.join(carry, by, "left")
    out = joined.withColumns({n: a.join_up(F.col(f"_c_{n}"), F.col(f"_i_{n}")) for n, a in aggs.items()})
    return out.drop(*[f"_{p}_{n}" for n in aggs for p in "vic"])


def neighbour(
    chunked: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Mapping[str, str | Column],
    *,
    following: bool = False,
) -> DataFrame:
    """Values of the previous (or following) row of the same key, across ranges."""
    by = [*keys, CHUNK]
    inner = Window.partitionBy(*by).orderBy(*order)
    chunks_in_order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)
    shift, edge = (F.lead, F.min_by) if following else (F.lag, F.max_by)
    work = chunked.withColumn("_row", F.struct(*[_col(c).alias(n) for n, c in cols.items()]))
    summary = work.groupBy(*by).agg(edge("_row", F.struct(*order)).alias("_edge"))
    carry = summary.select(*by, shift("_edge").over(chunks_in_order).alias("_carry"))
    out = work.withColumn("_near", shift("_row").over(inner)).join(carry, by, "left")
    out = out.withColumn("_near", F.coalesce("_near", "_carry"))
    return out.withColumns({n: F.col(f"_near.{n}") for n in cols}).drop("_row", "_near", "_carry")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    interpolate: bool = True,
) -> DataFrame:
    """Exact quantiles per key without gathering a key's values in one buffer.

    Equal values are counted first, the counts are range-partitioned and ranked by a
    running total, and only the rows that hold a wanted rank take part in the result.
    ``interpolate`` gives linear interpolation at p·(n−1); otherwise the order statistic
    at rank ⌈p·n⌉.
    """
    wanted, keys = list(keys), list(keys)
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = running(range_chunks(counts, keys, [value]), keys, [value], {"_upto": run_sum("_cnt")})
    totals = ranked.groupBy(*keys).agg(F.sum("_cnt").alias("_n"))
    ranked = ranked.join(totals, keys)

    def at(rank: Column) -> Column:  # zero-based rank
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_cnt")), F.col(value)))

    parts: list[Column] = []
    for name, p in probs.items():
        if interpolate:
            pos = F.lit(float(p)) * (F.col("_n") - 1)
            parts += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
        else:
            parts.append(at(F.greatest(F.ceil(F.lit(float(p)) * F.col("_n")) - 1, F.lit(0))).alias(name))
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *parts)
    if interpolate:
        for name, p in probs.items():
            pos = F.lit(float(p)) * (F.col("_n") - 1)
            lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
            out = out.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return out.select(*wanted, *probs)


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], step, schema: str) -> DataFrame:
    """Run an order-dependent fold over each key with constant memory.

    Rows are partitioned by ``keys`` and sorted on disk when needed; ``step(state, rows)``
    gets the state left by the previous batch of the same key (``None`` at first) and one
    pandas batch, and returns ``(state, output)``. No key is ever held as a whole. Callers
    add an island column to ``keys`` wherever the fold provably restarts, which spreads a
    hot key over many tasks.
    """
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            key = batch[names].astype(str)
            changed = (key != key.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            starts = [*dict.fromkeys([0, *changed]), len(batch)]
            for lo, hi in zip(starts, starts[1:]):
                head = tuple(key.iloc[lo])
                if head != current:
                    current, state = head, None
                state, out = step(state, batch.iloc[lo:hi])
                yield out

    placed = df.repartition(*[F.col(k) for k in names]).sortWithinPartitions(*names, *order)
    return placed.mapInPandas(run, schema)


def fold_ranges(
    chunked: DataFrame, keys: Sequence[str], order: Sequence[str], state: Mapping[str, str], step, schema: str,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Exact fold over long keys, with all ranges of a key folded at the same time.

    Each range first assumes an empty start state; the end states then become the start
    states of the following ranges, and only ranges whose start changed are folded again,
    until nothing changes. A fold that forgets its past (a quote book after one update of
    each side) settles in two or three rounds; the result is exact in every case.

    ``state`` maps the state columns, which ``step`` must put in every output row, to
    their types; the step finds the assumed start in columns ``start_<name>`` of the first
    row of a batch when it gets no state. ``initial`` (keys and state columns) is the state
    that an earlier run left per key.
    """
    by = [*keys, CHUNK]
    present = chunked.select(*by).distinct()
    if initial is None:
        starts = present.withColumns({f"start_{n}": F.lit(None).cast(t) for n, t in state.items()})
    else:
        left = initial.select(*keys, *[F.col(n).cast(t).alias(f"start_{n}") for n, t in state.items()])
        starts = present.join(left, list(keys), "left")
    begin = pin(starts)
    starts = begin
    folded, redo = None, starts
    in_order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)
    while True:
        fresh = fold_sorted(chunked.join(redo, by), by, order, step, schema)
        if folded is None:
            folded = pin(fresh)
        else:
            folded = pin(folded.join(redo.select(*by), by, "left_anti").unionByName(fresh))
        ends = folded.groupBy(*by).agg(F.max_by(F.struct(*state), F.struct(*order)).alias("_end"))
        following = ends.withColumn("_begin", F.lag("_end").over(in_order)).withColumn("_nth", F.row_number().over(in_order))
        given = begin.select(*by, F.struct(*[F.col(f"start_{n}").alias(n) for n in state]).alias("_given"))
        following = following.join(given, by).withColumn("_begin", F.when(F.col("_nth") == 1, F.col("_given")).otherwise(F.col("_begin")))
        wanted = following.select(*by, *[F.col(f"_begin.{n}").alias(f"start_{n}") for n in state])
        old = starts.select(*by, F.struct(*[f"start_{n}" for n in state]).alias("_old"))
        pairs = pin(wanted.join(old, by))
        redo = pairs.where(~F.struct(*[f"start_{n}" for n in state]).eqNullSafe(F.col("_old"))).drop("_old")
        if redo.isEmpty():
            return folded
        starts = pairs.drop("_old")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
