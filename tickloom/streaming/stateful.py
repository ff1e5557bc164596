"""Keyed state on streams: indicators over bars.

The state of a key is a dozen numbers, and a micro-batch brings it at most one bar per
elapsed interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.quality import BLOCKING
from tickloom.operators.indicators import Periods
from tickloom.streaming.support import use_rocksdb


class Smoother:
    """One smoothing as (count, total of the seed, value); NULL until the seed is full."""

    def __init__(self, n: int, decay: float, state: tuple | None = None):
        self.n, self.decay = n, decay
        self.count, self.total, self.value = state or (0, 0.0, None)

    def feed(self, x: float) -> float | None:
        self.count += 1
        if self.count <= self.n:
            self.total += x
            self.value = self.total / self.n if self.count == self.n else None
        else:
            self.value = self.decay * self.value + (1.0 - self.decay) * x
        return self.value

    @property
    def state(self) -> tuple:
        return self.count, self.total, self.value


def _rsi(gain: float | None, loss: float | None) -> float | None:
    if gain is None:
        return None
    if loss == 0:
        return 50.0 if gain == 0 else 100.0
    return 0.0 if gain == 0 else 100.0 - 100.0 / (1.0 + gain / loss)


_PARTS = ("fast", "slow", "gain", "loss", "atr")
_STATE = "prev_end bigint, prev_close double, " + ", ".join(
    f"{p}_n bigint, {p}_t double, {p}_v double" for p in _PARTS
)
_OUTPUT = "instrument string, tf_seconds int, start timestamp, close double, ema_fast double, ema_slow double, rsi double, atr double"


class IndicatorProcessor(StatefulProcessor):
    """EMA, RSI and ATR of one (instrument, timeframe), equal to the batch windows."""

    def __init__(self, periods: Periods):
        self.periods = periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("indicators", _STATE)

    def _load(self, raw: tuple | None):
        p = self.periods
        spec = {
            "fast": (p.ema_fast, 1 - 2 / (p.ema_fast + 1)), "slow": (p.ema_slow, 1 - 2 / (p.ema_slow + 1)),
            "gain": (p.rsi, (p.rsi - 1) / p.rsi), "loss": (p.rsi, (p.rsi - 1) / p.rsi), "atr": (p.atr, (p.atr - 1) / p.atr),
        }
        parts = {}
        for i, name in enumerate(_PARTS):
            kept = tuple(raw[2 + 3 * i : 5 + 3 * i]) if raw else None
            parts[name] = Smoother(*spec[name], kept)
        return (raw[0], raw[1], parts) if raw else (None, None, parts)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("start")  # one key's bars of one micro-batch
        prev_end, prev_close, parts = self._load(tuple(self._state.get()) if self._state.exists() else None)
        out = []
        for bar in frame.itertuples(index=False):
            start, end = int(bar.start_us), int(bar.end_us)
            usable = bool(bar.closed) and not set(bar.quality_flags) & set(BLOCKING)
            joined = prev_end is None or start == prev_end
            values = (None, None, None, None)
            if usable and joined:
                values, prev_close = self._advance(parts, bar, prev_close)
                prev_end = end
            else:
                _, _, parts = self._load(None)
                prev_close = None
                prev_end = end if bar.closed else None
            out.append((bar.instrument, bar.tf_seconds, bar.start, bar.close, *values))
        flat = [x for name in _PARTS for x in parts[name].state]
        self._state.update((prev_end, prev_close, *flat))
        yield pd.DataFrame(out, columns=["instrument", "tf_seconds", "start", "close", "ema_fast", "ema_slow", "rsi", "atr"])

    @staticmethod
    def _advance(parts, bar, prev_close):
        fast, slow = parts["fast"].feed(bar.close), parts["slow"].feed(bar.close)
        span = bar.high - bar.low
        gain = loss = None
        if prev_close is not None:
            change = bar.close - prev_close
            gain, loss = parts["gain"].feed(max(change, 0.0)), parts["loss"].feed(max(-change, 0.0))
            span = max(span, abs(bar.high - prev_close), abs(bar.low - prev_close))
        return (fast, slow, _rsi(gain, loss), parts["atr"].feed(span)), bar.close

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, periods: Periods = Periods()) -> DataFrame:
    from pyspark.sql import functions as F

    use_rocksdb(bars.sparkSession)
    fed = bars.withColumns({"start_us": F.unix_micros("start"), "end_us": F.unix_micros("end")})
    return fed.groupBy("instrument", "tf_seconds").transformWithStateInPandas(
        statefulProcessor=IndicatorProcessor(periods), outputStructType=_OUTPUT, outputMode="Append", timeMode="None"
    )
