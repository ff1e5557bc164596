"""Connected components of an edge table: in tasks, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import pin

TASK_EDGES = 1 << 20  # 16 MB of edges a task


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that are not their component's smallest node, and that smallest node."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _stars_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, each component of them as one star."""
    parts = [tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)) for batch in batches]
    if parts:
        a, b = roots_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _contracted(edges: DataFrame, rows: int) -> DataFrame:
    """``edges``, dealt to a task for every ``TASK_EDGES`` of ``rows`` and contracted there; a step makes at most two rows of one."""
    return edges.repartition(max(1, -(-rows // TASK_EDGES))).mapInArrow(_stars_of_task, "a long, b long")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges are (a, b) with a > b, and may repeat."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    root = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(root.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that is not its component's smallest node.

    Tasks contract the edges dealt to them, whose number is bounded; what fits into one task is done then, in a few jobs. With
    several tasks, each step moves every edge towards the smallest node known near it and is contracted in tasks again; the number of
    steps grows with the logarithm of the longest chain at most. Every step is written down, so a lost executor repeats one step.
    Loops and repeated edges are ignored.
    """
    now = pin(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b"))
    rows, seen = now.count(), None
    now = pin(_contracted(now, rows))
    while rows > TASK_EDGES:
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == seen:
            break
        rows, seen = check[0], check
        now = pin(_contracted(_stars(now), rows))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
