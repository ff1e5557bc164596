"""Outcomes that wait for prices, as keyed state with event-time timers.

A signal waits for its entry until the allowed age after its target has passed, then for each horizon until the allowed age
after its expiry. The state is keyed by series and time cell: a cell holds the signals whose target lies in it and the points that can
matter to them, so a busy series is spread over its cells and a cell's state goes when its time is over. One timer per cell
stands at the earliest moment at which something in it is due; no history is read again.

Rows come in any order that the watermark allows. A point that becomes known more than the allowed age after a target or an expiry
takes no part. A row of kind ``close``, later than everything else, closes the capture: the watermark passes all
timers, and what has no price is final.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.asof import BACKWARD
from tickloom.operators.outcomes import Contract
from tickloom.streaming.support import use_rocksdb

PARTS = 32  # of the points of a cell, so that a due item reads those near it only
ITEM = "signal_id string, direction string, target bigint, horizon double, due bigint, entry bigint, entry_use bigint, entry_price double, reason string"
SETTLED = (
    "simulation_id string, signal_id string, instrument string, direction string, horizon double, entry_price double, final_price double, "
    "entry_use_time timestamp, expiry timestamp, outcome string, net double, reason string"
)
_POINT = np.dtype([("event", "<i8"), ("available", "<i8"), ("ordinal", "<i8"), ("price", "<f8")])
_COLUMNS = [c.split()[0] for c in SETTLED.split(", ")]


def _us(seconds: float) -> int:
    return round(seconds * 1_000_000)


class PendingOutcomes(StatefulProcessor):
    """Items of one (instrument, cell): ``pending`` holds what waits, ``points`` the prices by part of the cell."""

    def __init__(self, horizons: Sequence[float], rule: Contract):
        self.horizons, self.rule = [float(h) for h in horizons], rule
        self.age, self.latency = _us(rule.max_age_seconds), _us(rule.latency_seconds)
        # Up to this long after its target a signal looks at points.
        self.window = (1 if rule.exit_rule == BACKWARD else 2) * self.age + max(_us(h) for h in self.horizons)
        self.part = max(1, -(-2 * self.window // PARTS))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getListState("pending", ITEM)
        self._points = handle.getMapState("points", "part bigint", "rows binary")

    # ---- input

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            points = frame[frame["kind"] == "point"]
            if len(points):
                self._keep(points)
            signals = frame[frame["kind"] == "signal"]
            if len(signals):
                target = signals["target"].to_numpy(np.int64)
                self._pending.appendList([
                    (s, d, int(t), None, int(t) + self.age, None, None, None, None) for s, d, t in zip(signals["signal_id"], signals["direction"], target, strict=True)
                ])
                self._wake(int(target.min()) + self.age)
            if len(points) or len(signals):
                # The last moment at which anything of this cell can be due; its state goes then.
                self._wake((int(key[1]) + 2) * self.window + self.age)
        yield from ()

    def _wake(self, at: int) -> None:
        self._handle.registerTimer(at // 1000 + 1)

    def _keep(self, points: pd.DataFrame) -> None:
        new = np.empty(len(points), _POINT)
        for name, column in (("event", "event"), ("available", "available"), ("ordinal", "ordinal"), ("price", "price")):
            new[name] = points[column].to_numpy()
        part = new["event"] // self.part
        for p in np.unique(part).tolist():
            own = new[part == p].tobytes()
            if self._points.containsKey((p,)):
                own = bytes(self._points.getValue((p,))[0]) + own
            self._points.updateValue((p,), (own,))

    def _read(self, parts: Sequence[int]) -> np.ndarray:
        """Points of some parts in the order of selection."""
        found = [np.frombuffer(bytes(self._points.getValue((p,))[0]), _POINT) for p in parts if self._points.containsKey((p,))]
        rows = np.concatenate(found) if found else np.zeros(0, _POINT)
        return rows[np.lexsort((rows["ordinal"], rows["available"], rows["event"]))]

    # ---- timers

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = int(expiredTimerInfo.getExpiryTimeInMs()) * 1000
        items = [tuple(r) for r in self._pending.get()] if self._pending.exists() else []
        if items and min(i[4] for i in items) < now:
            settled, waiting = self._settle(key[0], items, now)
            self._pending.put(waiting) if waiting else self._pending.clear()
            if waiting:
                self._wake(min(i[4] for i in waiting))
            if settled:
                yield pd.DataFrame(settled, columns=_COLUMNS)
            items = waiting
        if not items and now > (int(key[1]) + 2) * self.window + self.age:
            self._points.clear()

    def _settle(self, instrument: str, items: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
        """Results that are due before ``now``, and what goes on waiting; an entry that is found begins a wait per horizon."""
        settled, waiting = [], []
        todo = list(items)
        cache: dict[int, np.ndarray] = {}
        while todo:
            item = todo.pop()
            signal_id, direction, target, horizon, due, entry, use, price, _ = item
            if due >= now:
                waiting.append(item)
            elif horizon is None:
                hit, reason = self._entry(target, cache)
                for h in self.horizons:
                    if reason is None:
                        begin = max(target, int(hit["available"]))
                        origin = begin if self.rule.horizon_from == "entry" else target - self.latency
                        todo.append((signal_id, direction, target, h, origin + _us(h) + self.age, int(hit["event"]), begin, float(hit["price"]), None))
                    else:
                        settled.append(self._result(instrument, item, h, None, None, reason))
            else:
                expiry = due - self.age
                hit, reason = self._final(expiry, entry, cache)
                settled.append(self._result(instrument, item, horizon, expiry, hit, reason))
        return settled, waiting

    def _near(self, lo: int, hi: int, cache: dict[int, np.ndarray]) -> np.ndarray:
        parts = range(lo // self.part, hi // self.part + 1)
        for p in parts:
            if p not in cache:
                cache[p] = self._read([p])
        return np.concatenate([cache[p] for p in parts])

    def _entry(self, target: int, cache) -> tuple[np.void | None, str | None]:
        rows = self._near(target, target + self.age, cache)
        at = int(np.searchsorted(rows["event"], target))
        if at == len(rows) or int(rows["event"][at]) > target + self.age:
            return None, "PRICE_NOT_AVAILABLE"
        late = int(rows["available"][at]) - target > self.age
        return (None, "MAX_PRICE_AGE_EXCEEDED") if late else (rows[at], None)

    def _final(self, expiry: int, entry: int, cache) -> tuple[np.void | None, str | None]:
        if self.rule.exit_rule != BACKWARD:
            rows = self._near(max(expiry, entry + 1), expiry + self.age, cache)
            at = int(np.searchsorted(rows["event"], max(expiry, entry + 1)))
            if at == len(rows) or int(rows["event"][at]) > expiry + self.age:
                return None, "PRICE_NOT_AVAILABLE"
            late = int(rows["available"][at]) - expiry > self.age
            return (None, "MAX_PRICE_AGE_EXCEEDED") if late else (rows[at], None)
        rows = self._near(expiry - self.age, expiry, cache)
        usable = rows[(rows["event"] <= expiry) & (rows["event"] > entry) & (rows["available"] <= expiry + self.age)]
        if not len(usable) or expiry - int(usable["event"][-1]) > self.age:
            return None, "PRICE_NOT_AVAILABLE"
        return usable[-1], None

    def _result(self, instrument: str, item: tuple, horizon: float, expiry: int | None, hit, reason: str | None) -> tuple:
        signal_id, direction, _, _, _, _, use, price, _ = item
        rule, outcome, net, final = self.rule, "INDETERMINATE", None, None
        if hit is not None:
            final = float(hit["price"])
            move = final - price if direction == "UP" else price - final
            outcome = "TIE" if abs(move) <= rule.tie_tolerance else "WIN" if move > 0 else "LOSS"
            net = {"WIN": rule.stake * rule.payout, "LOSS": -rule.stake * rule.loss, "TIE": rule.tie_net}[outcome] - rule.cost
        stamp = lambda us: None if us is None else pd.Timestamp(us, unit="us")
        return f"{signal_id}:{int(horizon)}", signal_id, instrument, direction, horizon, price, final, stamp(use), stamp(expiry), outcome, net, reason

    def close(self) -> None:
        pass


def pending_outcomes(rows: DataFrame, horizons: Sequence[float], rule: Contract, *, delay: str = "1 minute") -> DataFrame:
    """Settled outcomes (``SETTLED``) of a stream of signals and points.

    ``rows``: kind (signal, point or close), at (when the row is known; the watermark follows it by ``delay``), instrument; signals have signal_id,
    direction, detected_at, points have event_time, available_at, ordinal (unique per instrument and instant), price. A point without a
    time or price, and a signal without a time, takes no part.
    """
    use_rocksdb(rows.sparkSession)
    job = PendingOutcomes(horizons, rule)
    us = F.unix_micros
    target = us("detected_at") + job.latency
    event = F.when(F.col("kind") == "point", us("event_time"))
    cell = F.floor(F.coalesce(event, target) / job.window).cast("bigint")
    # A point serves the signals of its own cell and of the one before.
    cells = F.when(F.col("kind") == "point", F.array(cell, cell - 1)).otherwise(F.array(cell))
    fed = rows.withWatermark("at", delay).select(
        "at", "instrument", "kind", "signal_id", "direction", target.alias("target"), us("event_time").alias("event"), us("available_at").alias("available"),
        F.coalesce(F.col("ordinal").cast("bigint"), F.lit(0).cast("bigint")).alias("ordinal"), F.col("price").cast("double").alias("price"), F.explode(cells).alias("cell"),
    )
    usable = ((F.col("kind") == "signal") & F.col("cell").isNotNull()) | ((F.col("kind") == "point") & F.col("event").isNotNull() & F.col("available").isNotNull() & F.col("price").isNotNull())
    fed = fed.where(usable | (F.col("kind") == "close")).withColumn("cell", F.coalesce("cell", F.lit(0).cast("bigint")))
    return fed.groupBy("instrument", "cell").transformWithStateInPandas(statefulProcessor=job, outputStructType=SETTLED, outputMode="Append", timeMode="EventTime")
