"""User-supplied parts: variant filters, strategies, and consumers of signals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.signals import as_signals
from tickloom.sources.commits import CommitLog
from tickloom.sources.tables import WriteConflict

VariantFilter = Column | Callable[[DataFrame], DataFrame] | None


def run_variants(rows: DataFrame, variants: Mapping[str, VariantFilter]) -> DataFrame:
    """The rows of each variant, tagged; a variant is a predicate or a frame function.

    Variants given as predicates share one pass over the rows.
    """
    plain = {n: v for n, v in variants.items() if not callable(v) or isinstance(v, Column)}
    custom = {n: v for n, v in variants.items() if n not in plain}
    frames = []
    if plain:
        tags = F.array_compact(F.array(*[
            F.lit(n) if v is None else F.when(v, F.lit(n)) for n, v in plain.items()
        ]))
        frames.append(rows.withColumn("variant", F.explode(tags)))
    frames += [fn(rows).withColumn("variant", F.lit(n)) for n, fn in custom.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


class Strategy(Protocol):
    """A rule over named bar frames. ``signals`` adds a ``direction`` column to its bars."""

    name: str
    warmup_bars: int

    def signals(self, bars: Mapping[str, DataFrame]) -> DataFrame: ...


def evaluate_strategies(strategies: Sequence[Strategy], bars: Mapping[str, DataFrame]) -> DataFrame:
    found = [as_signals(s.signals(bars), s.name) for s in strategies]
    return reduce(lambda a, b: a.unionByName(b), found)


class SignalConsumer(Protocol):
    """Receives the new signals of each micro-batch."""

    def consume(self, signals: DataFrame, batch_id: int) -> None: ...


def fan_out(consumers: Sequence[SignalConsumer]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands every batch to all consumers, computed once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for consumer in consumers:
                consumer.consume(batch, batch_id)
        finally:
            batch.unpersist()

    return each


def fan_out_committed(consumers: Mapping[str, SignalConsumer], logs: Mapping[str, CommitLog]) -> Callable[[DataFrame, int], None]:
    """As ``fan_out``, with a commit log per consumer: after a failure the batch is handed again only to those that did not take it.

    Every consumer gets its turn even when one before it fails; the first error is raised at the end, so that the stream
    stops and runs the batch again. A consumer that fails after part of its work sees the whole batch again.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        open_ = [name for name in consumers if (last := logs[name].latest()) < 0 or logs[name].read(last)["batch"] < batch_id]
        failed: list[Exception] = []
        batch.persist()
        try:
            for name in open_:
                try:
                    consumers[name].consume(batch, batch_id)
                except Exception as error:
                    failed.append(error)
                    continue
                if not logs[name].commit(logs[name].latest() + 1, {"batch": batch_id}):
                    raise WriteConflict(f"two streams feed the consumer {name}")
        finally:
            batch.unpersist()
        if failed:
            raise failed[0]

    return each
