"""Column helpers: time grid, prices, availability, vocabulary, small maths."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = str | Column


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- time ---------------------------------------------------------------

_UNIT_SECONDS = {"S": 1, "M": 60, "H": 3600, "D": 86400}


def timeframe_seconds(name: str | int) -> int:
    """``M5``, ``5M``, ``H1``, ``30S``, ``D1`` or a plain number of seconds."""
    if isinstance(name, int):
        seconds = name
    elif str(name).strip().isdigit():
        seconds = int(str(name).strip())
    else:
        text = str(name).strip().upper()
        m = re.fullmatch(r"([SMHD])(\d+)", text) or re.fullmatch(r"(\d+)([SMHD])", text)
        if not m:
            raise ValueError(f"unknown timeframe: {name!r}")
        unit, n = (m[1], m[2]) if m[1].isalpha() else (m[2], m[1])
        seconds = int(n) * _UNIT_SECONDS[unit]
    if seconds <= 0:
        raise ValueError("a timeframe must be positive")
    return seconds


def interval_ordinal(t: C, seconds: int) -> Column:
    """Number of whole intervals since the Unix epoch."""
    return F.floor(F.unix_micros(col(t)) / F.lit(seconds * 1_000_000))


def interval_start(t: C, seconds: int) -> Column:
    us = seconds * 1_000_000
    return F.timestamp_micros(F.unix_micros(col(t)) - F.pmod(F.unix_micros(col(t)), F.lit(us)))


def plus_seconds(t: C, seconds: C | float) -> Column:
    if isinstance(seconds, int | float):
        micros = F.lit(round(seconds * 1_000_000)).cast("bigint")
    else:
        micros = F.round(col(seconds).cast("decimal(20,6)") * F.lit(1_000_000)).cast("bigint")
    return F.timestamp_micros(F.unix_micros(col(t)) + micros)


def seconds_between(a: C, b: C) -> Column:
    return (F.unix_micros(col(b)) - F.unix_micros(col(a))) / F.lit(1_000_000)


def day_block(day: C, width: int, origin: str = "1970-01-01") -> Column:
    return F.floor(F.datediff(col(day), F.lit(origin).cast("date")) / F.lit(width))


def session_label(t: C) -> Column:
    """UTC trading session by hour."""
    h = F.hour(col(t))
    return (
        F.when(h < 7, "ASIA").when(h < 12, "LONDON").when(h < 17, "NEW_YORK").when(h < 22, "NY_LATE").otherwise("OFF")
    )


def hour_block(t: C) -> Column:
    """0, 1 or 2: the eight-hour block of the UTC day."""
    return F.floor(F.hour(col(t)) / 8)


def parse_instant(c: C, unit: str = "iso8601", assume_timezone: str | None = None) -> Column:
    """Text to instant; NULL when it cannot be read without guessing."""
    raw = F.trim(col(c).cast("string"))
    if unit == "iso8601":
        has_zone = raw.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
        zoned = F.try_to_timestamp(raw)
        if assume_timezone is None:
            return F.when(has_zone, zoned)
        return F.when(has_zone, zoned).otherwise(F.to_utc_timestamp(F.try_to_timestamp(raw), assume_timezone))
    number = raw.try_cast("decimal(38,9)")
    scale = {"s": 1_000_000, "ms": 1_000, "us": 1}
    if unit in scale:
        return F.timestamp_micros(F.floor(number * F.lit(scale[unit])).cast("bigint"))
    if unit == "ns":
        return F.timestamp_micros(F.floor(number / 1000).cast("bigint"))
    raise ValueError(f"unknown timestamp unit: {unit!r}")


# ---- prices and clocks --------------------------------------------------

def selected_price(base: C = "price_base", price: C = "price", bid: C = "bid", ask: C = "ask") -> Column:
    """Price of the asked base; NULL when its side is missing, never another base."""
    b = normal_price_base(base)
    return (
        F.when(b.isin("traded", "native"), col(price))
        .when(b == "bid", col(bid))
        .when(b == "ask", col(ask))
        .when(b == "mid", (col(bid) + col(ask)) / 2)
    )


def effective_available(available: C = "available_at", received: C = "received_at", event: C = "event_time") -> Column:
    return F.coalesce(col(available), col(received), col(event))


# Accepted spellings of a price base.
PRICE_BASES = ("traded", "bid", "ask", "mid", "native")
PRICE_BASE_ALIASES = {
    "trade": "traded",
    "close": "traded",
    "provider_native": "native",
    "provider-native": "native",
}


def normal_price_base(c: C) -> Column:
    """Canonical base name; NULL for an unknown spelling."""
    text = F.lower(F.trim(col(c)))
    out = F.when(text.isin(*PRICE_BASES), text)
    for spelling, name in PRICE_BASE_ALIASES.items():
        out = out.when(text == spelling, name)
    return out


def finite(c: C) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def near(a: C, b: C, tolerance: float = 1e-9) -> Column:
    """Equal within a tolerance that is both relative and absolute."""
    x, y = col(a), col(b)
    return F.abs(x - y) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y)), F.lit(tolerance))


def first_filled(*values: C, default: str = "UNKNOWN") -> Column:
    """First value that is not blank, else the default label."""
    cleaned = [F.nullif(F.trim(col(v).cast("string")), F.lit("")) for v in values]
    return F.coalesce(*cleaned, F.lit(default))


def codes(rules: Mapping[str, Column] | Sequence[tuple[str, Column]]) -> Column:
    """Array of the codes whose condition is true, in the given order."""
    pairs = rules.items() if isinstance(rules, Mapping) else rules
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in pairs]))


def break_even(stake: C, payout: C, loss: C, cost: C) -> Column:
    """Win probability at which the expected result is zero; NULL when undefined."""
    s, r, k, c = col(stake), col(payout), col(loss), col(cost)
    return F.try_divide(s * k + c, F.nullif(s * (r + k), F.lit(0.0)))


def floor_to_step(q: C, step: C) -> Column:
    return F.floor(col(q) / col(step)) * col(step)


def month_text(c: C) -> Column:
    """``YYYYMM`` or ``YYYY-MM`` to ``YYYY-MM``; NULL when neither."""
    raw = F.trim(col(c))
    tidy = F.regexp_extract(raw, r"^(\d{4})-?(0[1-9]|1[0-2])$", 1)
    month = F.regexp_extract(raw, r"^(\d{4})-?(0[1-9]|1[0-2])$", 2)
    return F.when(tidy != "", F.concat_ws("-", tidy, month))


def pair_alias(c: C) -> Column:
    """Upper-case trimmed instrument name with the usual exchange alias resolved."""
    return F.regexp_replace(F.upper(F.trim(col(c))), r"\bXBT\b", "BTC")


def redact(df, secret_names: Sequence[str] = ("token", "secret", "password", "api_key", "authorization")):
    """Drop columns with secret names and mask ``name: value`` pairs inside text columns."""
    keep = [c for c in df.columns if not any(s in c.lower() for s in secret_names)]
    pattern = r'(?i)("?(?:' + "|".join(secret_names) + r')"?\s*[:=]\s*)("[^"]*"|[^,\s}]+)'
    text = {n for n, t in df.dtypes if t == "string"}
    return df.select(*[F.regexp_replace(c, pattern, "$1***").alias(c) if c in text else F.col(c) for c in keep])
