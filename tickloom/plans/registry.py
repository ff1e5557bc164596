"""Registration of the named queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import fit_input, fit_local, ship_package, use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Simple column types for a result: naive UTC instants, doubles instead of decimals."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "timestamp":
            c = c.cast("timestamp_ntz").alias(name)
        elif kind.startswith("decimal"):
            c = c.cast("double").alias(name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            fit_local(spark)
            fit_input(spark)
            ship_package()
            return plain(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(c, digits: int = 6):
    """Rounded copy of a double column, under its own name when given as text."""
    return F.round(F.col(c), digits).alias(c) if isinstance(c, str) else F.round(c, digits)


def text_list(c: str):
    return F.concat_ws(",", c).alias(c)
