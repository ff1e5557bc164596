"""Collocations of each language by multikey quicksort of suffix pointers.

A pointer to a word stands for the words from there to the end of its piece, at most ``DEPTH``. Sorted by words, all
occurrences of a phrase lie together, and the sizes of the equal partitions of a three-way quicksort are the
phrases' counts. Partitions that hold fewer than ``LEAST`` occurrences are abandoned: no phrase in them counts.

* First pass: pairs of neighbouring words are counted by hash. The frequent ones become a bit filter of fixed size
  (``FILTER_BITS``); a pointer ends before a pair that is not in it, since no phrase over that pair can be frequent. A
  false hit of the filter, or a full one, costs only work.
* Second pass: pointers, combined in each task where equal, are routed by (language, leading word), so that one task sorts all
  pointers with that word. Leading words that hold more than a small share of all pointers are routed by their first
  two words, and pairs that do by all their words. What such a split divides (counts of the shorter prefixes) is added up after the sort.
* Scores, the test against longer candidates and the best phrases are joins and aggregates over the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text_bytes import LOWER, Hasher, mix, slices, utf8, words
from tickloom.session import pin, shuffle_width

DEPTH = 4
LEAST = 30
TOP = 2000
SHARE = 80  # per cent of a phrase's count that a longer candidate needs to replace it
UNKNOWN = "und"
FILTER_BITS = 1 << 27  # a power of two, 32,768 at least
SLICE = 2 << 20
BLOCK_ROWS = 400_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Pieces:
    """The words of a slice of texts, their hashes by language, and how many words follow in the same piece."""

    def __init__(self, hasher: Hasher, langs: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
        self.data = data = LOWER[data]
        self.starts, self.ends, at = words(data, offs, _SPACE | _STOP)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        self.word = hasher.ranges(data, self.starts, self.ends)
        stops = np.concatenate(([0], np.cumsum(_STOP[data])))
        self.joined = (stops[self.starts[1:]] == stops[self.ends[:-1]]) & (self.doc[1:] == self.doc[:-1])  # by word: the next one is in its piece
        self.lang = langs[self.doc] if len(self.doc) else np.zeros(0, np.uint64)
        own = mix(self.word * _WORD + self.lang)
        self.single = own & ~np.uint64(1)
        self.pair = mix(own[:-1] * _PAIR + self.word[1:])[: len(self.joined)] | np.uint64(1)


def _lang_hashes(column: pa.Array) -> np.ndarray:
    data, offs = utf8(column)
    return Hasher().ranges(data, offs[:-1], offs[1:])


def _counted(batches: Iterator[pa.RecordBatch], held: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (key, n) of the words and pairs of a task."""
    hasher, kept, size = Hasher(), [], 0

    def combined() -> pa.RecordBatch:
        nonlocal size
        keys, n = np.unique(np.concatenate(kept), return_counts=True)
        kept.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "n"])

    for batch in batches:
        langs = _lang_hashes(batch.column(0))
        for lo, hi, data, offs in slices(batch.column(1), SLICE):
            found = Pieces(hasher, langs[lo:hi], data, offs)
            kept += [found.single, found.pair[found.joined]]
            size += len(found.single) + int(found.joined.sum())
            if size > held:
                yield combined()
    if kept:
        yield combined()


class Routing:
    """What the second pass needs to know of the first: the filter of frequent pairs, and the keys that hold many rows."""

    def __init__(self, bits: np.ndarray, hot: np.ndarray) -> None:
        self.bits, self.hot = bits, hot

    def frequent(self, pairs: np.ndarray) -> np.ndarray:
        place = pairs >> np.uint64(64 - (8 * len(self.bits) - 1).bit_length())
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(keys), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)] == keys


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First row and count of each distinct row of some columns of whole numbers from 0."""
    rank = columns[0]
    for c in columns[1:]:
        _, rank = np.unique(rank * (int(c.max()) + 1) + c, return_inverse=True)
    _, first, n = np.unique(rank, return_index=True, return_counts=True)
    return first, n


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings ``data[start:start + size]``."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    out = data[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(out)])


def _pointers(batches: Iterator[pa.RecordBatch], routing: Routing) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, n, route, lead): the distinct pointers of each slice, cut before pairs that are not frequent.

    ``route`` is a hash of the first ``lead`` words.
    """
    hasher = Hasher()
    for batch in batches:
        langs = _lang_hashes(batch.column(0))
        names = batch.column(0)
        for lo, hi, data, offs in slices(batch.column(1), SLICE):
            p = Pieces(hasher, langs[lo:hi], data, offs)
            n = len(p.word)
            if not n:
                continue
            on = np.zeros(n + DEPTH, bool)
            on[: n - 1] = p.joined
            on[: n - 1][p.joined] = routing.frequent(p.pair[p.joined])
            length = np.ones(n, np.int64)
            for k in range(1, DEPTH):
                length += (length == k) & on[k - 1 : n + k - 1]
            # A word after a pointer's end counts as 0, so that equal pointers are equal rows.
            _, ids = np.unique(p.word, return_inverse=True)
            ids = np.concatenate((ids + 1, np.zeros(DEPTH, np.int64)))
            _, lang = np.unique(p.lang, return_inverse=True)
            first, count = _distinct([lang, *(np.where(length > k, ids[k : n + k], 0) for k in range(DEPTH))])
            size, lead = length[first], np.ones(len(first), np.int64)
            lead[routing.is_hot(p.single[first])] = 2
            pair = np.concatenate((p.pair, np.zeros(1, np.uint64)))[first]
            lead[(lead == 2) & (size >= 2) & routing.is_hot(pair)] = DEPTH
            route = p.lang[first]
            word = np.concatenate((p.word, np.zeros(DEPTH, np.uint64)))
            for k in range(DEPTH):
                use = (lead > k) & (size > k)
                route = np.where(use, mix(route * _WORD + word[first + k]), route)
            # The words of a phrase one after another, with single spaces.
            sizes = p.ends - p.starts + 1
            upto = np.concatenate(([0], np.cumsum(sizes)))
            source = np.repeat(p.starts - upto[:-1], sizes) + np.arange(upto[-1])
            source[upto[1:] - 1] = len(data)
            spaced = np.concatenate((p.data, np.array([0x20], np.uint8)))[source]
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(lo + p.doc[first])), _gathered(spaced, upto[first], upto[first + size] - 1 - upto[first]), pa.array(count.astype(np.int64)),
                    pa.array(route.astype(np.int64)), pa.array(lead.astype(np.int8)),
                ],
                names=["lang", "phrase", "n", "route", "lead"],
            )


def multikey_quicksort(keys: np.ndarray, weights: np.ndarray, least: int, whole: int = 1) -> list[tuple[int, int, int]]:
    """(row, depth, count) of the equal partitions of a three-way quicksort by columns: ``row`` has the prefix of ``depth`` columns.

    A key of 0 ends a row. Partitions of a weight below ``least`` are abandoned, but not those of prefixes shorter than
    ``whole``, of which other tasks may hold more.
    """
    found = []
    open_ = [(np.arange(len(keys)), 0)] if len(keys) else []
    while open_:
        rows, depth = open_.pop()
        if depth + 1 >= whole and int(weights[rows].sum()) < least:
            continue
        own = keys[rows, depth]
        pivot = own[len(own) // 2] if len(own) < 8 else np.sort(own[[0, len(own) // 2, -1]])[1]
        equal = own == pivot
        if pivot:
            same = rows[equal]
            count = int(weights[same].sum())
            if count >= least or depth + 1 < whole:
                found.append((int(same[0]), depth + 1, count))
                if depth + 1 < keys.shape[1]:
                    open_.append((same, depth + 1))
        if not equal.all():
            less = own < pivot
            open_ += [(part, depth) for part in (rows[less], rows[~less & ~equal]) if len(part)]
    return found


def _sorted_counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, n) of pointers in order of their route; phrase '' has all words of a language."""
    rest: pa.Table | None = None

    def counted(rows: pa.Table) -> pa.RecordBatch:
        names = rows.column("lang").combine_chunks().dictionary_encode()
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        data, offs = utf8(rows.column("phrase"))
        weights, lead = rows.column("n").to_numpy(), rows.column("lead").to_numpy()
        starts, ends, at = words(data, offs, _SPACE)
        texts = _gathered(data, starts, ends - starts).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        keys = np.zeros((len(weights), DEPTH), np.int64)
        depth = np.arange(len(texts)) - np.repeat(at[:-1], np.diff(at))
        keys[np.repeat(np.arange(len(weights)), np.diff(at)), depth] = texts
        keys[:, 0] += lang * (int(texts.max()) + 1)
        found = []
        for whole in np.unique(lead).tolist():
            own = np.flatnonzero(lead == whole)
            found += [(int(own[r]), d, c) for r, d, c in multikey_quicksort(keys[own], weights[own], least, whole)]
        all_ = np.bincount(lang, weights).astype(np.int64)
        row = np.array([r for r, _, _ in found], np.int64)
        last = at[row] + np.array([d for _, d, _ in found], np.int64) - 1
        phrases = pa.concat_arrays([_gathered(data, offs[row], ends[last] - offs[row] if len(row) else np.zeros(0, np.int64)), pa.array([""] * len(all_), pa.string())])
        which = pa.array(np.concatenate((lang[row], np.arange(len(all_)))))
        counts = pa.array(np.concatenate((np.array([c for _, _, c in found], np.int64), all_)))
        return pa.RecordBatch.from_arrays([names.dictionary.cast(pa.string()).take(which), phrases, counts], names=["lang", "phrase", "n"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rest = rows if rest is None else pa.concat_tables([rest, rows])
        if len(rest) >= BLOCK_ROWS:
            route = rest.column("route").to_numpy()
            cut = int(np.flatnonzero(route != route[-1])[-1]) + 1 if (route != route[-1]).any() else 0
            if cut:
                yield counted(rest.slice(0, cut))
                rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield counted(rest)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (lang, phrase, n) of all phrases of 1 to ``DEPTH`` words with n >= ``least``, and phrase '' with all words of a lang."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    width = shuffle_width(spark)
    keys = docs.mapInArrow(_counted, "key long, n long").repartition(width, "key").groupBy("key").agg(F.sum("n").alias("n"))
    keys = pin(keys.where(F.col("n") >= least))  # an even key is a word, an odd one a pair
    # Spark's bitmaps count places from 1.
    frequent = keys.where("key % 2 <> 0").select((F.shiftrightunsigned("key", 64 - (FILTER_BITS - 1).bit_length()) + 1).alias("place"))
    # The filter comes in parts of 4 KB, at most FILTER_BITS / 8 bytes together.
    parts = frequent.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        bits[4096 * (r["part"] - 1) : 4096 * r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    total = keys.where("key % 2 = 0").agg(F.sum("n")).first()[0] or 0
    # Fewer than 8 * width keys of either kind hold so many rows.
    hot = keys.where(F.col("n") > F.lit(max(least, total // (4 * width)))).select("key").toPandas()["key"]
    routing = spark.sparkContext.broadcast(Routing(bits, np.sort(hot.to_numpy(np.int64).astype(np.uint64))))
    rows = docs.mapInArrow(lambda b: _pointers(b, routing.value), "lang string, phrase string, n long, route long, lead byte")
    ordered = rows.repartition(width, "route").sortWithinPartitions("route")
    counts = ordered.mapInArrow(lambda b: _sorted_counts(b, least), "lang string, phrase string, n long")
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def _parts(words_: Column, first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words_, first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of 2 to ``DEPTH`` words of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of the phrase and of the two parts of its lowest-scoring cut, n those of all words of the language. A null lang
    is 'und'; a null or empty text has no words; repeated rows count each time; other columns are ignored. Equal scores
    come by count, then by the phrase's bytes. A language without a phrase that counts has no rows, an empty table none at all.
    """
    counts = pin(phrase_counts(docs, least))
    words_ = F.split("phrase", " ")
    own = counts.where("phrase <> ''").withColumn("words", words_).withColumn("size", F.size("words"))
    phrases = own.where("size >= 2").select("lang", "phrase", F.col("n").alias("a"), "words", "size")
    cuts = phrases.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _parts(F.col("words"), F.lit(1), F.col("k")).alias("left"), _parts(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    score = F.expr("cast(2000000bd * cast(a as decimal(19,0)) div cast(l + r as decimal(19,0)) as long)")
    cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).groupBy("lang", "phrase").agg(F.first("a").alias("a"), cut)
    longer = phrases.where("size >= 3").select("lang", F.col("a").alias("longer"), "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"), "size")
    longer = longer.select("lang", "longer", "words", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    longer = longer.groupBy("lang", _parts(F.col("words"), F.col("at"), F.col("k")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100bd * longer < {SHARE} * a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each salt first, so that a language's phrases need not meet in one task.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(docs.sparkSession)))
    kept = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return kept.join(counts.where("phrase = ''").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
