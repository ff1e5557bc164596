"""Literal frames for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.schemas import BARS, TICKS

EPOCH = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return EPOCH + timedelta(seconds=seconds)


def ticks(spark, rows, base="traded"):
    """rows: (instrument, second, price[, quantity])"""
    data = []
    for i, r in enumerate(rows):
        price = r[2]
        data.append((
            r[0], at(r[1]), at(r[1]), None, price, r[3] if len(r) > 3 else 1.0, price, price, base, "trade", i, f"e{i}", "t", ["valid"],
        ))
    return spark.createDataFrame(data, TICKS)


def bars(spark, closes, tf=60, instrument="X", start=0, closed=True, flags=("valid",), skip=()):
    data = []
    for i, c in enumerate(closes):
        if i in skip:
            continue
        s = start + i * tf
        o, h, lo, cl = c if isinstance(c, tuple) else (c, c, c, c)
        data.append((instrument, tf, at(s), at(s + tf), float(o), float(h), float(lo), float(cl), 1.0, 1, closed, False, at(s + tf), list(flags), 1))
    return spark.createDataFrame(data, BARS)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def seconds(c):
    return ((F.unix_micros(c) - F.lit(int(EPOCH.timestamp()) * 1_000_000)) / 1_000_000).alias(c if isinstance(c, str) else "s")
