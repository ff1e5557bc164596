"""Two-sided quote book from one-sided updates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scan import fold_ranges, range_chunks, run_last, run_max, running
from tickloom.session import pin

_STATE = {"bid": "double", "ask": "double", "bid_us": "bigint", "ask_us": "bigint"}


def _apply(state, side: str, price: float, us: int):
    """One update on the held book: (new state, what happened)."""
    bid, ask, bid_us, ask_us = state
    held = bid_us if side == "bid" else ask_us
    if held is not None and us < held:
        return state, "OUT_OF_ORDER"
    new = (price, ask, us, ask_us) if side == "bid" else (bid, price, bid_us, us)
    if new[0] is not None and new[1] is not None and new[1] < new[0]:
        return state, "CROSSED"
    return new, "APPLIED"


def _blank(v):
    return None if v is None or v != v else v


def quote_book(updates: DataFrame, keys: Sequence[str], arrival: str, held: DataFrame | None = None) -> DataFrame:
    """Book after every update, exact, including refused and crossed updates.

    ``updates``: keys, arrival ordinal, side ('bid'/'ask'), price, us (source time in
    microseconds). A side older than the held one is refused; an update that would cross
    the book is dropped and the held book stays. ``held`` is the book per key from before.
    """
    names = [*keys, "_chunk", arrival]

    def step(state, batch: pd.DataFrame):
        if state is None:
            first = batch.iloc[0]
            state = tuple(_blank(first[f"start_{n}"]) for n in _STATE)
        rows, marks = [], []
        for side, price, us in zip(batch["side"], batch["price"], batch["us"]):
            state, mark = _apply(state, side, price, us)
            rows.append(state)
            marks.append(mark)
        book = pd.DataFrame(rows, columns=list(_STATE), index=batch.index)
        book = book.astype({"bid": "float64", "ask": "float64", "bid_us": "Int64", "ask_us": "Int64"})
        return state, pd.concat([batch[names], book], axis=1).assign(status=marks)

    chunked = range_chunks(updates, keys, [arrival])
    kinds = dict(chunked.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", "
    schema += ", ".join(f"{n} {t}" for n, t in _STATE.items()) + ", status string"
    return fold_ranges(chunked, keys, [arrival], _STATE, step, schema, held).drop("_chunk")


def quote_book_windowed(updates: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The same book by running windows only; exact up to the first crossed update.

    ``exact`` is false from the first crossed row of a key on, where only the fold knows
    which book was held.
    """
    is_bid, is_ask = F.col("side") == "bid", F.col("side") == "ask"
    chunked = range_chunks(updates, keys, [arrival])
    seen = running(
        chunked, keys, [arrival],
        {"_bid_top": run_max(F.when(is_bid, F.col("us"))), "_ask_top": run_max(F.when(is_ask, F.col("us")))},
        inclusive=False,
    )
    fresh = F.when(is_bid, F.coalesce(F.col("us") >= F.col("_bid_top"), F.lit(True))).otherwise(
        F.coalesce(F.col("us") >= F.col("_ask_top"), F.lit(True))
    )
    seen = pin(seen.withColumn("_fresh", fresh))  # the next two scans read it
    book = running(seen, keys, [arrival], {
        "bid": run_last(F.when(is_bid & F.col("_fresh"), F.col("price"))),
        "ask": run_last(F.when(is_ask & F.col("_fresh"), F.col("price"))),
    })
    crossed = F.coalesce(F.col("ask") < F.col("bid"), F.lit(False))
    ranked = running(pin(book.withColumn("_crossed", crossed.cast("int"))), keys, [arrival], {"_any": run_max("_crossed")})
    return ranked.select(*keys, arrival, "bid", "ask", (F.col("_any") == 0).alias("exact"))

