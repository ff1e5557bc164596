"""A training corpus from raw documents: each stage keeps, repeats or packs what the stage before it left.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. ``ORACLE_SQL`` is
None: a learned score, a near-duplicate join and a tokenizer are not expressible in SQL, so the stages are tested
against brute-force versions.

What a stage pins goes when the next one begins, which reads the written output only; so one pipeline runs at a time in an application. Null, empty
and repeated texts, clashing ids and other columns are treated as the stages' operators say; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tickloom.llm.queries import vocabulary
from tickloom.llm.registry import table
from tickloom.session import drop_folder, drop_pinned, fit_batches, pins, scratch_path, ship_package

SCOPE = "pipeline"


def stage(fn):
    """A stage of the pipeline: drops what the stage before it pinned, and pins in the pipeline's own scope."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package()
        fit_batches(spark)
        drop_pinned(spark, SCOPE)
        with pins(SCOPE):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels of these documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.with_groups(docs).where("kept").select(*docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one whose id names the component; of clashing ids just one row."""
    return ngram_join.one_of_each(docs).select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order."""
    return mixing.mix(docs).select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("n-gram join", drop_near_copies),
    ("mixing", mix_sources), ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows lie in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, work in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
