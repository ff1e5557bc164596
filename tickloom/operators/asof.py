"""As-of joins on two clocks, without a range join.

Both sides are put in one stream, ordered by the instant at which a row counts, and each
left row reads a running maximum (or minimum) of the right rows before it. The scan works
on ranges of equal size, so neither a hot key nor a burst gathers in one task, and a left
row never meets more than one right row. Of the stretches of time without a left row only the
rows that can be the answer take part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scan import range_chunks, run_max, run_min, running


CELL_US = 900 * 1_000_000


def _can_win(rows_r: DataFrame, rows_l: DataFrame, keys: Sequence[str], first: str, *, newest: bool) -> DataFrame:
    """The right rows that some left row can choose.

    Time is cut into cells. All left rows see a cell without left rows whole or not at all, so of such a cell only the rows
    with its best value of the hit's ``first`` field (the one hits are compared by) can be chosen. Other cells stay whole.
    """
    at = [*keys, "_cell"]
    cell = F.floor(F.col("_t") / CELL_US).alias("_cell")
    value = F.col("_hit").getField(first)
    best = rows_r.groupBy(*keys, cell).agg((F.max(value) if newest else F.min(value)).alias("_top"))
    asked = rows_l.select(*keys, cell).distinct().withColumn("_asked", F.lit(True))
    cells = best.join(asked, at, "left")
    kept = F.col("_asked").isNotNull() | value.isNull() | (value == F.col("_top"))
    return rows_r.select("*", cell).join(cells, at).where(kept).select(*rows_r.columns)


def _scan(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: Column, right_at: Column,
    left_id: Sequence[str], right_row: Column, right_id: Sequence[str], *, first: str, newest: bool,
) -> DataFrame:
    ident = lambda cols: F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    rows_r = right.select(
        *keys, right_at.alias("_t"), F.lit(0).alias("_side"), ident(right_id).alias("_tie"), right_row.alias("_hit")
    ).where(F.col("_t").isNotNull())
    rows_l = left.select(
        *keys, left_at.alias("_t"), F.lit(1).alias("_side"), ident(left_id).alias("_tie"),
        F.struct(*left.columns).alias("_left"),
    ).where(F.col("_t").isNotNull())
    both = _can_win(rows_r, rows_l, keys, first, newest=newest).unionByName(rows_l, allowMissingColumns=True)
    order = ["_t", "_side", "_tie"]
    chunked = range_chunks(both, keys, order)
    found = running(chunked, keys, order, {"_best": run_max("_hit") if newest else run_min("_hit")})
    return found.where(F.col("_side") == 1).select("_left.*", "_best")


def latest_known(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("instrument",),
    left_at: str = "available_at",
    left_id: Sequence[str],
    time: str = "event_time",
    available: str = "available_at",
    right_id: Sequence[str],
    values: Sequence[str],
    prefix: str = "q_",
) -> DataFrame:
    """For each left row, the right row with the greatest (time, available) whose time
    and availability are both at or before ``left_at``.

    Every left row stays; one whose ``left_at`` is unknown has no right row.
    """
    hit = F.struct(time, F.col(available).alias("_avail"), *right_id, *[v for v in values if v not in right_id])
    right_at = F.unix_micros(F.greatest(time, available))
    out = _scan(
        left, right, keys, F.unix_micros(left_at), right_at, left_id, hit, right_id, first=time, newest=True
    )
    picked = {f"{prefix}{v}": F.col(f"_best.{v}") for v in values}
    found = out.withColumns({**picked, f"{prefix}time": F.col(f"_best.{time}")}).drop("_best")
    return found.unionByName(left.where(F.col(left_at).isNull()), allowMissingColumns=True)


FORWARD = "first_observation_at_or_after"
BACKWARD = "last_observation_at_or_before"


def select_price(
    targets: DataFrame,
    points: DataFrame,
    *,
    target: str,
    target_id: Sequence[str],
    rule: str,
    max_age: float,
    after: str | None = None,
    prefix: str = "",
    keys: Sequence[str] = ("instrument",),
) -> DataFrame:
    """One price point per target under the shared selection policy.

    ``points`` holds eligible rows only: instrument, event_time, available_at, price,
    ordinal, point_id (closed, admissible quality, wanted price base). ``after`` names an
    instant that the point's market time must exceed. The age of the chosen point is the
    larger of market distance and availability delay; a first candidate that is too old
    ends the search.
    """
    us = F.unix_micros
    age_us = round(max_age * 1_000_000)
    hit = F.struct("event_time", "available_at", "ordinal", "point_id", "price")
    known = targets.where(F.col(target).isNotNull())
    if rule == FORWARD:
        bound = us(target)
        if after is not None:
            bound = F.greatest(bound, us(after) + 1)
        found = _scan(known, points, keys, -bound, -us("event_time"), target_id, hit, ["point_id"], first="event_time", newest=False)
    elif rule == BACKWARD:
        usable_from = F.greatest(us("event_time"), us("available_at") - F.lit(age_us))
        found = _scan(known, points, keys, us(target), usable_from, target_id, hit, ["point_id"], first="event_time", newest=True)
        if after is not None:
            found = found.withColumn("_best", F.when(F.col("_best.event_time") > F.col(after), F.col("_best")))
    else:
        raise ValueError(f"unknown rule: {rule!r}")
    best = lambda c: F.col(f"_best.{c}")
    distance = us(best("event_time")) - us(target)
    age = F.greatest(F.abs(distance), us(best("available_at")) - us(target), F.lit(0)) / F.lit(1_000_000)
    reason = F.when(F.col("_best").isNull(), "PRICE_NOT_AVAILABLE").when(age > max_age, "MAX_PRICE_AGE_EXCEEDED")
    found = found.withColumns({"_age": age, f"{prefix}reason": reason})
    ok = F.col(f"{prefix}reason").isNull()
    use = F.greatest(target, "_best.available_at") if rule == FORWARD else best("available_at")
    found = found.withColumns({
        f"{prefix}price": F.when(ok, best("price")),
        f"{prefix}time": F.when(ok, best("event_time")),
        f"{prefix}available": F.when(ok, best("available_at")),
        f"{prefix}point_id": F.when(ok, best("point_id")),
        f"{prefix}age": F.when(ok, F.col("_age")),
        f"{prefix}use_time": F.when(ok, use),
    }).drop("_best", "_age")
    if rule not in (FORWARD, BACKWARD):
        return found
    absent = targets.where(F.col(target).isNull())
    return found.unionByName(absent, allowMissingColumns=True)
