"""Exact duplicates by skew-safe combining, in DataFrame operations only.

1. Each task first merges the equal texts it has read (the map side of the first aggregation).
2. Digest groups are merged per salt. Only digests held by more than 1 / ``HOT_SHARE`` of all rows
   are salted: there are fewer than ``HOT_SHARE`` of them, so their list may be broadcast.
3. The winners of a digest's salts are merged globally; these rows are at most ``SALTS`` a text.

The full normalised text is part of every grouping key, so no decision rests on a digest. Only the
way back from a group to its rows goes by digest; should two different texts ever share one, the
job stops with an error instead of mixing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import pin

HOT_SHARE = 4096
HOT_LEAST = 64
SALTS = 32
DECISIONS = ("keep_id", "group_size", "kept", "text_sha256")
_SHA, _SALT, _TEXT, _KEEP, _N = "__digest", "__salt", "__normal", "__keep", "__count"


def normalised(text: Column | str) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def with_groups(docs: DataFrame, salts: int = SALTS, hot_share: int = HOT_SHARE) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts (white space runs count as one space, null as empty) the row with the smallest
    doc_id stays; null ids come last. Of rows that also share the doc_id exactly one stays. Every
    input row is returned once; columns with the names of the decisions are replaced. An empty table
    gives an empty table.
    """
    docs = docs.drop(*DECISIONS)
    rows = docs.withColumn(_TEXT, normalised("text")).withColumn(_SHA, F.sha2(_TEXT, 256))
    light = pin(rows.groupBy(_SHA).agg(F.count(F.lit(1)).alias(_N)))
    total = light.agg(F.coalesce(F.sum(_N), F.lit(0))).first()[0]
    # More rows than this each: at most ``hot_share`` digests, a bound that does not grow with the table.
    hot = light.where(F.col(_N) > max(HOT_LEAST, total // hot_share)).select(_SHA, F.lit(True).alias("__hot"))

    def salted(df: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
        return df.join(F.broadcast(hot), _SHA, "left").withColumn(_SALT, F.when(F.col("__hot"), own).otherwise(0)).drop("__hot")

    merged = salted(rows.select("doc_id", _SHA, _TEXT)).groupBy(_SHA, _SALT, _TEXT).agg(F.min("doc_id").alias(_KEEP), F.count(F.lit(1)).alias(_N))
    merged = pin(_with_text_of_hot(merged, hot))
    cold = merged.where(F.col(_TEXT).isNull()).select(_SHA, _SALT, _KEEP, _N)
    salt_winners = merged.where(F.col(_TEXT).isNotNull())
    whole = salt_winners.groupBy(_SHA, _TEXT).agg(F.min(_KEEP).alias(_KEEP), F.sum(_N).alias(_N))
    back = salt_winners.select(_SHA, _SALT, _TEXT).join(whole, [_SHA, _TEXT]).select(_SHA, _SALT, _KEEP, _N)
    winners = (
        cold.unionByName(back).groupBy(_SHA, _SALT)
        .agg(F.min(_KEEP).alias(_KEEP), F.min(_N).alias(_N), F.count(F.lit(1)).alias("__texts"))
        .withColumn(_KEEP, F.when(F.col("__texts") > 1, F.raise_error(F.lit("two different texts share a SHA-256 digest")).cast("long")).otherwise(F.col(_KEEP)))
        .drop("__texts")
    )
    found = salted(rows.drop(_TEXT)).join(winners, [_SHA, _SALT])
    repeat = F.row_number().over(Window.partitionBy(_SHA, _SALT, "doc_id").orderBy(F.lit(0)))
    return found.select(
        *[f"`{c}`" for c in docs.columns], F.col(_KEEP).alias("keep_id"), F.col(_N).alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col(_KEEP)) & (repeat == 1)).alias("kept"), F.col(_SHA).alias("text_sha256"),
    )


def _with_text_of_hot(merged: DataFrame, hot: DataFrame) -> DataFrame:
    """Groups of unsalted digests are complete and need their text no longer."""
    return merged.join(F.broadcast(hot), _SHA, "left").withColumn(_TEXT, F.when(F.col("__hot"), F.col(_TEXT))).drop("__hot")
