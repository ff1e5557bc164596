"""Keyset pages, even-index downsampling and bounded polls."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scan import range_chunks, run_count, running


class CursorMismatch(ValueError):
    pass


@dataclass(frozen=True)
class PageSpec:
    """What a cursor is bound to: table, order and filters."""

    table: str
    time: str
    ident: str
    size: int
    descending: bool = False
    filters: tuple[tuple[str, object], ...] = ()
    start: str | None = None
    end: str | None = None

    @property
    def scope(self) -> str:
        text = json.dumps(
            [self.table, self.time, self.ident, self.descending, [list(f) for f in self.filters], self.start, self.end], default=str
        )
        return sha256(text.encode()).hexdigest()[:16]


def encode_cursor(spec: PageSpec, micros: int, ident: object, direction: str = "after") -> str:
    body = json.dumps({"s": spec.scope, "t": micros, "i": ident, "d": direction})
    return base64.urlsafe_b64encode(body.encode()).decode()


def _decode(spec: PageSpec, cursor: str) -> tuple[int, object, str]:
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as exc:
        raise CursorMismatch("unreadable cursor") from exc
    if body.get("s") != spec.scope:
        raise CursorMismatch("the cursor belongs to another query")
    return body["t"], body["i"], body["d"]


def selected(df: DataFrame, spec: PageSpec) -> DataFrame:
    """Range and equality filters, in a form that Parquet can push down."""
    out = df
    if spec.start is not None:
        out = out.where(F.col(spec.time) >= F.lit(spec.start).cast("timestamp"))
    if spec.end is not None:
        out = out.where(F.col(spec.time) < F.lit(spec.end).cast("timestamp"))
    for name, value in spec.filters:
        out = out.where(F.col(name).isin(*value) if isinstance(value, list | tuple) else F.col(name) == F.lit(value))
    return out


def page(df: DataFrame, spec: PageSpec, cursor: str | None = None) -> DataFrame:
    """One page plus one look-ahead row, in display order, found by keyset, not offset."""
    rows = selected(df, spec)
    backwards = False
    if cursor is not None:
        micros, ident, direction = _decode(spec, cursor)
        backwards = direction == "before"
        t, i = F.unix_micros(spec.time), F.col(spec.ident)
        at = F.timestamp_micros(F.lit(micros))
        ascending = spec.descending == backwards
        edge = (F.col(spec.time) >= at) if ascending else (F.col(spec.time) <= at)
        later = (t > micros) | ((t == micros) & (i > F.lit(ident)))
        earlier = (t < micros) | ((t == micros) & (i < F.lit(ident)))
        rows = rows.where(edge & (later if ascending else earlier))
    ascending = spec.descending == backwards
    key = [F.asc(spec.time), F.asc(spec.ident)] if ascending else [F.desc(spec.time), F.desc(spec.ident)]
    return rows.orderBy(*key).limit(spec.size + 1)


@dataclass(frozen=True)
class Page:
    rows: list
    next_cursor: str | None
    total: int


def fetch(df: DataFrame, spec: PageSpec, cursor: str | None = None) -> Page:
    """A page as rows on the driver: at most ``size`` of them, by design of a page."""
    got = page(df, spec, cursor).withColumn("_t", F.unix_micros(spec.time)).collect()
    shown = got[: spec.size]
    more = len(got) > spec.size
    last = encode_cursor(spec, shown[-1]["_t"], shown[-1][spec.ident]) if more else None
    return Page(shown, last, selected(df, spec).count())


def explode_conditions(decisions: DataFrame, conditions: str, keep: Sequence[str]) -> DataFrame:
    """One row per condition with its ordinal; a decision without conditions keeps one row."""
    return decisions.select(*keep, F.posexplode_outer(conditions).alias("ordinal", "condition"))


def downsample(rows: DataFrame, keys: Sequence[str], order: Sequence[str], points: int) -> DataFrame:
    """At most ``points`` rows per key at evenly spaced ranks, first and last included."""
    ranked = running(range_chunks(rows, keys, order), keys, order, {"_rank": run_count(F.lit(1))}).drop("_chunk")
    sizes = ranked.groupBy(*keys).agg(F.max("_rank").alias("_n"))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    wanted = sizes.where(F.col("_n") > points).withColumn("_i", i).select(
        *keys, (F.rint(F.col("_i") * (F.col("_n") - 1) / F.lit(points - 1)).cast("bigint") + 1).alias("_rank")
    ).distinct()
    every = sizes.where(F.col("_n") <= points).withColumn("_rank", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    return ranked.join(wanted.unionByName(every.select(*keys, "_rank")), [*keys, "_rank"], "left_semi").drop("_rank")


def latest(df: DataFrame, time: str, ident: str, n: int, tag: str) -> DataFrame:
    """Newest ``n`` rows of a table in a common shape, for a bounded poll of several tables."""
    return df.orderBy(F.desc(time), F.desc(ident)).limit(n).select(
        F.lit(tag).alias("source"), F.col(time).alias("at"), F.col(ident).cast("string").alias("ident")
    )


def dimension_filter(df: DataFrame, wanted: dict[str, object], paths: dict[str, Column]) -> DataFrame:
    """Filter by report dimensions that live in nested columns."""
    out = df
    for name, value in wanted.items():
        out = out.where(paths[name] == F.lit(value))
    return out
