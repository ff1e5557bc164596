"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source of ``size`` characters that shall fill the share ``w`` of ``total`` characters needs each of its
documents ``w * total / size`` times on average. Each document is repeated by an inverted Poisson
distribution of that mean: its count is the number of k with P(X <= k) <= u, where u is a hash of seed and
doc_id. No document waits for another, so a retried task repeats alike, and the expected size of every
source is its target whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import pin

SEED = "mix-1"
TEMPERATURE = 0.7
# Above so many probabilities the table of sources is joined by shuffle instead of sent to all tasks.
BROADCAST_VALUES = 200_000


def unit_hash(*parts):
    """A number in [0, 1) with 52 random bits from the text of ``parts``."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """One row per source: ``size`` (characters, at least 1 a document), ``weight`` and ``rate``.

    Without ``weights`` a source weighs size ** ``temperature``. Named weights are used as given and
    scaled to one; a source that is not named gets none. ``total`` is the size of the mix, by default that
    of the input. A null source is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0)))).alias("size"))
    if weights is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(raw)
    sizes = pin(sizes.withColumn("raw", raw))
    all_ = sizes.agg(F.sum("size").cast("double").alias("size"), F.sum("raw").alias("raw")).first()
    goal, weight_sum = float(total if total is not None else all_["size"] or 0.0), float(all_["raw"] or 0.0)
    return sizes.select("source", "size", (F.col("raw") / F.lit(weight_sum or 1.0)).alias("weight")).withColumn("rate", F.col("weight") * F.lit(goal) / F.col("size"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """Per source the array of P(X <= k), up to where the rest is below double precision."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    order = Window.partitionBy("source").orderBy("k")
    log_factorial = F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(order)
    p = F.exp(-F.col("rate") + F.col("k") * F.log("rate") - log_factorial)
    cumulated = steps.withColumn("p", p).withColumn("upto", F.sum("p").over(order))
    # One array a source; its length follows that source's own repetition rate.
    return cumulated.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "upto"))), lambda x: x["upto"]).alias("__upto"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, seed: str = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` repeated to the target weights and shuffled, with ``copy`` (from 1) and ``copies``.

    Rows are dealt to partitions and ordered there by a hash of seed, doc_id and copy. A document whose
    count is 0 is absent. Equal rows have equal counts. Columns named ``copy`` or ``copies`` are replaced;
    an empty table gives an empty table.
    """
    docs = docs.drop("copy", "copies")
    table = pin(poisson_table(source_rates(docs, weights, total, temperature)))
    values = table.agg(F.coalesce(F.sum(F.size("__upto")), F.lit(0))).first()[0]
    side = table.withColumnRenamed("source", "__source")
    joined = docs.join(F.broadcast(side) if values <= BROADCAST_VALUES else side, F.col("source").eqNullSafe(F.col("__source")))
    # The hash is the start value and so computed once, not for each probability.
    start = F.struct(unit_hash(F.lit(seed), F.col("doc_id")).alias("u"), F.lit(0).alias("n"))
    step = lambda a, c: F.struct(a["u"].alias("u"), (a["n"] + F.when(c <= a["u"], 1).otherwise(0)).alias("n"))
    counted = joined.withColumn("copies", F.aggregate("__upto", start, step, lambda a: a["n"])).drop("__upto", "__source")
    spread = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.xxhash64(F.lit(seed), "doc_id", "copy")
    spread = spread.withColumn("__key", key).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key").sortWithinPartitions("__key")
    return spread.select(*[f"`{c}`" for c in docs.columns], "copy", "copies")
