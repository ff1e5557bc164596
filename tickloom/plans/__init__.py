"""Named queries. Importing the modules below fills the registry."""

from __future__ import annotations

import importlib

_MODULES = (
    "bar_queries", "indicator_queries", "source_queries", "row_queries", "join_queries", "ledger_queries", "inference_queries",
    "structure_queries", "stream_queries",
)


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tickloom.plans.{name}")


def all_queries():
    _load()
    from tickloom.plans.registry import QUERIES

    return dict(QUERIES)


def all_oracles():
    _load()
    from tickloom.plans.registry import ORACLES

    return dict(ORACLES)
