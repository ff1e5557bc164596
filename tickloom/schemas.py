"""Column layout of the frames that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_ts = T.TimestampType()
_str = T.StringType()
_dbl = T.DoubleType()
_big = T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


TICKS = _struct(
    ("instrument", _str), ("event_time", _ts), ("available_at", _ts), ("received_at", _ts),
    ("price", _dbl), ("quantity", _dbl), ("bid", _dbl), ("ask", _dbl), ("price_base", _str),
    ("event_kind", _str), ("seq", _big), ("event_id", _str), ("source", _str),
    ("quality_flags", T.ArrayType(_str)),
)

BARS = _struct(
    ("instrument", _str), ("tf_seconds", T.IntegerType()), ("start", _ts), ("end", _ts),
    ("open", _dbl), ("high", _dbl), ("low", _dbl), ("close", _dbl), ("volume", _dbl),
    ("event_count", _big), ("closed", T.BooleanType()), ("partial", T.BooleanType()),
    ("available_at", _ts), ("quality_flags", T.ArrayType(_str)), ("revision", T.IntegerType()),
)

QUOTES = _struct(
    ("instrument", _str), ("event_time", _ts), ("available_at", _ts),
    ("bid", T.DecimalType(20, 10)), ("ask", T.DecimalType(20, 10)), ("sequence", _big),
    ("source_event_id", _str), ("month", _str),
)

CAPTURE = _struct(
    ("event_time", _ts), ("received_at", _ts), ("available_at", _ts), ("ingest_sequence", _big),
    ("connection_generation", T.IntegerType()), ("message_class", _str), ("payload", _str),
    ("schema_version", T.IntegerType()),
)

LEDGER = _struct(
    ("trade_id", _str), ("variant", _str), ("instrument", _str), ("direction", _str),
    ("units", T.DecimalType(18, 2)), ("entry_at", _ts), ("close_at", _ts),
    ("entry_price", T.DecimalType(18, 6)), ("close_price", T.DecimalType(18, 6)),
    ("gross", T.DecimalType(18, 4)), ("cost", T.DecimalType(18, 4)), ("net", T.DecimalType(18, 4)),
    ("state", _str), ("session", _str), ("regime", _str), ("initial_risk", T.DecimalType(18, 4)),
    ("episode_id", _str),
)
