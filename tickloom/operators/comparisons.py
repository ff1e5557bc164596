"""Experiments side by side, where they share the identity that makes them comparable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARED, INCOMPATIBLE = "COMPARED", "INCOMPATIBLE"


def identity_check(runs: DataFrame, comparison: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """One row per comparison: state, the ``mismatches`` among the identity columns, and each identity that is the same in all runs.

    An identity column matches when all runs have one value; unknown (null) counts as a value, so a comparison of known and unknown is refused. The
    smallest and the largest value tell it, so no list of values is gathered and the runs of a comparison combine before the shuffle.
    """
    facts = []
    for c in identity:
        facts += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"), F.count(c).alias(f"_known_{c}")]
    rows = runs.groupBy(*comparison).agg(F.count(F.lit(1)).alias("runs"), *facts)
    single = {c: F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}")) & F.col(f"_known_{c}").isin(0, F.col("runs")) for c in identity}
    unlike = F.array_compact(F.array(*[F.when(~ok, c) for c, ok in single.items()]))
    out = rows.withColumn("mismatches", unlike).withColumn("state", F.when(F.size("mismatches") == 0, COMPARED).otherwise(INCOMPATIBLE))
    return out.select(*comparison, "state", "mismatches", "runs", *[F.when(ok, F.col(f"_lo_{c}")).alias(c) for c, ok in single.items()])


def compare(runs: DataFrame, comparison: Sequence[str], identity: Sequence[str], variant: str, results: Sequence[str], *, strict: bool = True) -> DataFrame:
    """``identity_check`` with the results of each comparison in ``side_by_side``: an array of (variant, results) in order of the variant.

    ``runs`` has one row per comparison and variant. A refused comparison shows no results when ``strict``; otherwise it shows them and
    keeps its mismatches.
    """
    judged = identity_check(runs, comparison, identity)
    table = runs.groupBy(*comparison).agg(F.array_sort(F.collect_list(F.struct(variant, *results))).alias("side_by_side"))
    out = judged.join(table, list(comparison))
    return out.withColumn("side_by_side", F.when(F.col("state") == COMPARED, F.col("side_by_side"))) if strict else out
