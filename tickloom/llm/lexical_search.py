"""Ranked lexical search of a set of items over all documents, by bags that many documents share.

A document is seen through the items' vocabulary only: its bag is the vector of its term counts there, and with the
number m of its length it has all that a score depends on. Documents with equal (bag, m) are one class. Equal bags are
merged in the task that reads the texts and again after a shuffle by their hash, comparing whole bags each time, so a
group of copies is one row per task, however large it is. Each class is scored once for all items; as its members
score alike, only its ``k`` smallest doc_ids can be in a result and only they are kept with it.

Items are taken in blocks of at most ``BLOCK_TERMS`` (item, term) pairs (an item with more is a block by itself); a
block's vocabulary is what is broadcast. Each block reads all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text_bytes import LOWER, Hasher, Table, slices, words
from tickloom.session import pin, shuffle_width

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_TERMS = 1_000_000
HELD_BYTES = 32 << 20  # of the bags that a task remembers before it passes them on
CELLS = 1 << 20
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_BAG_SCHEMA = "n long, bag binary, ids array<long>, docs long, words long, term int, df long"


def terms_of(text: Column) -> Column:
    """Terms of a text in order, with repeats; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, SMALL), F.lit(TERM), F.lit(0))


class Vocabulary:
    """Terms of a block of items: hashes, bytes, and for each term the items that hold it."""

    def __init__(self, pairs: list[tuple[int | None, str]]) -> None:
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i or 0))
        self.terms = sorted({t.encode() for _, t in pairs})
        place, number = {t: k for k, t in enumerate(self.terms)}, {i: k for k, i in enumerate(self.items)}
        self.data = np.frombuffer(b"".join(self.terms), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.terms], dtype=np.int64)
        self.begins = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.hashes = Hasher().ranges(self.data, self.begins, self.ends)
        term = np.array([place[t.encode()] for _, t in pairs], np.int64)
        item = np.array([number[i] for i, _ in pairs], np.int64)
        self.holders = item[np.argsort(term, kind="stable")]
        self.holds = np.bincount(term, minlength=len(self.terms))
        self.first_holder = np.cumsum(self.holds) - self.holds

    def find(self, table: Table, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 where the vocabulary does not have it; found words are compared byte by byte."""
        found = table.find(hashes)
        rows = np.flatnonzero(found >= 0)
        sizes = ends[rows] - starts[rows]
        same = sizes == (self.ends - self.begins)[found[rows]]
        found[rows[~same]] = -1
        rows, sizes = rows[same], sizes[same]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        inside = np.arange(upto[-1]) - np.repeat(upto[:-1], sizes)
        wrong = data[np.repeat(starts[rows], sizes) + inside] != self.data[np.repeat(self.begins[found[rows]], sizes) + inside]
        count = np.concatenate(([0], np.cumsum(wrong)))
        found[rows[count[upto[1:]] > count[upto[:-1]]]] = -1
        return found


def _smallest(ids: list[int | None], k: int) -> list[int | None]:
    return sorted(ids, key=lambda i: (i is None, i or 0))[:k]


def _bags(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (n, bag, ids) of the bags that a task has met; then its counts of documents, words and documents by term."""
    hasher, table = Hasher(), Table(vocabulary.hashes)
    docs = total = held = 0
    df = np.zeros(len(vocabulary.terms), np.int64)
    seen: dict[tuple[int, bytes], list[int | None]] = {}

    def rows(n, bag, ids, counts=(None, None, None, None)) -> pa.RecordBatch:
        size = max(len(c) for c in (n, *counts) if c is not None)
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        values = [x if x is not None and len(x) else [None] * size for x in (n, bag, ids, *counts)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["n", "bag", "ids", "docs", "words", "term", "df"])

    def emptied() -> pa.RecordBatch:
        out = rows([n for n, _ in seen], [b for _, b in seen], list(seen.values()))
        seen.clear()
        return out

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for lo, _, data, offs in slices(batch.column(1)):
            data = LOWER[data]
            starts, ends, at = words(data, offs, _BETWEEN)
            n = np.diff(at)
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            found = vocabulary.find(table, data, starts, ends, hasher.ranges(data, starts, ends))
            known = np.flatnonzero(found >= 0)
            cells, tf = np.unique(np.repeat(np.arange(len(n)), n)[known] * len(df) + found[known], return_counts=True)
            doc, term = np.divmod(cells, max(1, len(df)))
            df += np.bincount(term, minlength=len(df))
            packed = np.stack((term, tf), axis=1).astype("<u4").tobytes()
            edges = 8 * np.searchsorted(doc, np.arange(len(n) + 1))
            for i, (a, b, size) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), n.tolist(), strict=True)):
                if a == b:
                    continue  # holds no item's term, so no item's score is above 0
                key = (size, packed[a:b])
                ids = seen.get(key)
                if ids is None:
                    seen[key] = [doc_ids[lo + i]]
                    held += b - a + 200
                else:
                    ids.append(doc_ids[lo + i])
                    if len(ids) > 4 * k:
                        seen[key] = _smallest(ids, k)
            if held > HELD_BYTES:
                yield emptied()
                held = 0
    if seen:
        yield emptied()
    some = np.flatnonzero(df)
    yield rows([], None, None, ([docs], [total], None, None))
    if len(some):
        yield rows([], None, None, (None, None, some, df[some]))


class Best:
    """The classes that can hold one of an item's ``k`` best documents, for all items."""

    def __init__(self, k: int, items: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.item = self.score = self.null = self.first = np.zeros(0, np.int64)
        self.members: list[list[int | None]] = []

    def add(self, scores: np.ndarray, members: list[list[int | None]]) -> None:
        """``scores``: classes by items; ``members``: the smallest doc_ids of each class, ascending, null ones last."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        null = np.array([m[0] is None for m in members], np.int64)[row]
        first = np.array([m[0] or 0 for m in members], np.int64)[row]
        cols = [np.concatenate(x) for x in ((self.item, item), (self.score, scores[row, item]), (self.null, null), (self.first, first))]
        order = np.lexsort((cols[3], cols[2], -cols[1], cols[0]))
        item = cols[0][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        old = len(self.members)
        self.members = [self.members[j] if j < old else members[row[j - old]] for j in order.tolist()]
        self.item, self.score, self.null, self.first = (c[order] for c in cols)
        full = rank[rank < self.k] == self.k - 1
        self.least[self.item[full]] = self.score[full]  # an equal score may still go before it by its doc_id

    def rows(self) -> tuple[np.ndarray, list[int | None], np.ndarray]:
        """Item number, doc_id and score of the ``k`` best documents of each item."""
        sizes = [len(m) for m in self.members]
        ids = [i for m in self.members for i in m]
        item, score = np.repeat(self.item, sizes), np.repeat(self.score, sizes)
        order = np.lexsort((np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool), -score, item))
        item = item[order]
        order = order[np.arange(len(item)) - np.searchsorted(item, item) < self.k]
        return np.repeat(self.item, sizes)[order], [ids[j] for j in order.tolist()], score[order]


def scores_of(bags: list[bytes], m: np.ndarray, weights: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray]]:
    """Whole-number scores of runs of classes: first, after the last, classes by items."""
    sizes = np.array([len(b) // 8 for b in bags], np.int64)
    pairs = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
    term, tf = pairs[:, 0], pairs[:, 1]
    gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    work = np.concatenate(([0], np.cumsum(vocabulary.holds[term])))[edges] + np.arange(len(edges)) * len(vocabulary.items)
    lo = 0
    while lo < len(bags):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + 2 * CELLS, "right")) - 1)
        part = slice(edges[lo], edges[hi])
        holds = vocabulary.holds[term[part]]
        upto = np.cumsum(holds) - holds
        item = vocabulary.holders[np.repeat(vocabulary.first_holder[term[part]] - upto, holds) + np.arange(holds.sum())]
        cell = np.repeat(np.repeat(np.arange(hi - lo), sizes[lo:hi]), holds) * len(vocabulary.items) + item
        each, cells = np.repeat(gain[part], holds), (hi - lo) * len(vocabulary.items)
        # Two sums of at most 53 bits: bincount adds doubles.
        high = np.bincount(cell, each >> 20, cells).astype(np.int64)
        low = np.bincount(cell, each & (1 << 20) - 1, cells).astype(np.int64)
        yield lo, hi, ((high << 20) + low).reshape(hi - lo, -1)
        lo = hi


def _scored(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, weights: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (hash, m, bag, ids) in order of the hash to the best documents of this task's classes."""
    best = Best(k, len(vocabulary.items))
    open_hash: int | None = None
    run: dict[tuple[int, bytes], list[int | None]] = {}
    ready: list[tuple[int, bytes, list[int | None]]] = []

    def score() -> None:
        m = np.array([x[0] for x in ready], np.int64)
        for lo, hi, scores in scores_of([x[1] for x in ready], m, weights, vocabulary):
            best.add(scores, [x[2] for x in ready[lo:hi]])
        ready.clear()

    for batch in batches:
        for h, m, bag, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if h != open_hash:
                ready += [(*key, _smallest(own, k)) for key, own in run.items()]
                run.clear()
                open_hash = h
                if len(ready) >= 4096:
                    score()
            own = run.get((m, bag))
            if own is None:
                run[m, bag] = ids
            else:
                run[m, bag] = _smallest(own + ids, k)
    ready += [(*key, _smallest(own, k)) for key, own in run.items()]
    if ready:
        score()
    item, ids, score_ = best.rows()
    yield pa.RecordBatch.from_arrays(
        [pa.array([vocabulary.items[i] for i in item.tolist()], pa.int64()), pa.array(ids, pa.int64()), pa.array(score_, pa.int64())], names=["item_id", "doc_id", "score"]
    )


def _block(docs: DataFrame, pairs: list[tuple[int | None, str]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(pairs))
    terms = len(vocabulary.value.terms)
    bags = pin(docs.mapInArrow(lambda b: _bags(b, vocabulary.value, k), _BAG_SCHEMA))
    n_docs, n_words = bags.agg(F.sum("docs"), F.sum("words")).first()
    counted = bags.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # at most the block's terms
    df = np.zeros(terms, np.int64)
    df[counted["term"].to_numpy(np.int64)] = counted["df"].to_numpy(np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    m = (F.lit(100 - 90) + F.expr(f"(90 * cast(n as decimal(15,0)) * {n_docs}bd) div {max(1, n_words)}bd")).cast("long")
    classes = bags.where("bag is not null").select(m.alias("m"), "bag", "ids").select(F.xxhash64("m", "bag").alias("hash"), "m", "bag", "ids")
    ordered = classes.repartition(shuffle_width(spark), "hash").sortWithinPartitions("hash")
    return ordered.mapInArrow(lambda b: _scored(b, vocabulary.value, weights, k), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    Documents have (doc_id, text), items (item_id, text); other columns are ignored. Equal scores come by ascending doc_id, null
    ones last; rows that share a doc_id are documents of their own. Rows that share an item_id (or have none) are one item with the
    terms of all. A null or empty text has no terms; an item without terms, or whose terms no document holds, has no
    rows, and an empty table of either kind gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = pin(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term")).distinct())
    blocks = max(1, math.ceil(pairs.count() / block_terms))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = []
    for block in range(blocks):
        own = [(r.item_id, r.term) for r in dealt.where(F.col("block") == block).collect()]
        if own:
            found.append(_block(docs, own, k))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
