"""Packing of tokenised documents into sequences of at most ``SEQUENCE`` tokens.

Documents are dealt evenly to tasks, taken there in groups of ``GROUP`` documents, or fewer that
make ``GROUP_TOKENS`` tokens, and packed group by group: whole sequences are cut from a long document first, its rest and all shorter
documents are placed by first-fit decreasing. A tournament tree over the bins holds the
largest free capacity below each node, so the first bin that fits is found from the root in
logarithmic time. A group never sees another group's bins; what a task holds is bounded by
the group, and a document longer than the group only by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text_bytes import LOWER, NOT_LETTER, Hasher, slices, words

SEQUENCE = 4096
END_OF_TEXT = 2
GROUP = 2048
GROUP_TOKENS = 1 << 22
CACHE_WORDS = 1_000_000
_BETWEEN, _BETWEEN_ID = b"<|endoftext|>", 49407

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Free capacity of the bins of one group; every inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """First bin with ``need`` free places; takes them."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.free[node] < need:
                node += 1
        bin_no = node - self.leaves
        self.free[node] -= need
        node //= 2
        while node:
            self.free[node] = max(self.free[2 * node], self.free[2 * node + 1])
            node //= 2
        return bin_no


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset for each length, in the order given; ties keep that order."""
    tree, used, out = CapacityTree(len(lengths), capacity), {}, [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = tree.place(lengths[i])
        out[i] = (b, used.get(b, 0))
        used[b] = out[i][1] + lengths[i]
    return out


def pack_group(lengths: list[int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group.

    A sequence that would be padded is cut at powers of two, largest first, where more than
    ``capacity / 16`` places would stay free: sequences of such a length need no padding.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    rests, sequence = [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((d, whole * capacity, n % capacity))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for (d, start, n), (b, offset) in zip(rests, first_fit_decreasing([r[2] for r in rests], capacity), strict=True):
        bins.setdefault(b, []).append((d, start, n))
    for b in sorted(bins):
        total = sum(n for _, _, n in bins[b])
        room = 1 << (total.bit_length() - 1) if capacity - total > capacity // 16 else capacity
        offset = 0
        for d, start, n in bins[b]:
            while n:
                take = min(n, room - offset)
                pieces.append((d, start, take, sequence, offset))
                start, n, offset, total = start + take, n - take, offset + take, total - take
                if offset == room and total:
                    sequence, offset, room = sequence + 1, 0, 1 << (total.bit_length() - 1)
        sequence += 1
    return pieces


class WordTokenizer:
    """Ids of whole texts from the ids of their words.

    The vocabulary's pre-tokenizer never joins text across ASCII white space, nor a letter with a
    full stop or comma after it, and it folds case; so a text's ids are those of its lower-case words
    and stops one after another. Each distinct word goes through the tokenizer once as long as the
    cache (bounded) holds it; new words go together, with a special token between them. Slices that
    hold a special token's text are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.hasher = Tokenizer.from_file(path), Hasher()
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.sizes = np.zeros(0, np.int32)
        self.begins = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, fresh: np.ndarray, texts: list[bytes]) -> None:
        joined = _BETWEEN.join([*texts, b""]).decode("utf-8", "replace")
        found = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        after = np.flatnonzero(found == _BETWEEN_ID)
        ends = after - np.arange(len(after))
        begins = np.concatenate((np.zeros(1, ends.dtype), ends[:-1]))
        keys = np.concatenate((self.keys, fresh))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.sizes = np.concatenate((self.sizes, (ends - begins).astype(np.int32)))[order]
        self.begins = np.concatenate((self.begins, (begins + len(self.ids)).astype(np.int32)))[order]
        self.ids = np.concatenate((self.ids, found[found != _BETWEEN_ID]))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a slice, with the end mark."""
        end = np.array([END_OF_TEXT], np.uint32)
        if b"<|" in (raw := data.tobytes()):
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            return [np.concatenate((np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32), end)) for t in texts]
        data = LOWER[data]
        starts, ends, at = words(data, offs, breaks=_stop_after_letter(data))
        hashes = self.hasher.ranges(data, starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._missing(distinct)
        if len(new):
            if len(self.keys) + len(new) > CACHE_WORDS and len(self.keys):
                self._empty()
                new = np.arange(len(distinct))
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        spot = np.searchsorted(self.keys, distinct)[inverse]
        sizes = self.sizes[spot]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.repeat(self.begins[spot] - upto[:-1], sizes) + np.arange(upto[-1])]
        return [np.concatenate((ids[upto[a] : upto[b]], end)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _missing(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(distinct))
        where = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        return np.flatnonzero(self.keys[where] != distinct)


def _stop_after_letter(data: np.ndarray) -> np.ndarray:
    """Marks bytes that begin a stop or comma right after an ASCII or Latin-1 letter."""
    out = np.zeros(len(data), bool)
    if len(data) > 2:
        letter = ~NOT_LETTER[data] & (data < 0x80)
        latin = data >= 0x80
        latin[1:] &= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        latin[0] = False
        out[1:] = ((data[1:] == 0x2E) | (data[1:] == 0x2C)) & (letter | latin)[:-1]
    return out


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, group: int, group_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tokenizer, base, sequence = WordTokenizer(vocabulary), TaskContext.get().partitionId() << 40, 0
    docs: list[tuple[int | None, np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal sequence, held
        rows = pack_group([len(ids) for _, ids in docs], capacity)
        crcs = [zlib.crc32(docs[d][1][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([docs[d][0] for d, *_ in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()), pa.array(crcs, pa.int64()),
                pa.array([len(docs[d][1]) for d, *_ in rows], pa.int64()),
                pa.array([base + sequence + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        sequence += max((r[3] for r in rows), default=-1) + 1
        docs.clear()
        held = 0
        return out

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for lo, _, data, offs in slices(batch.column(1)):
            for i, ids in enumerate(tokenizer.encode(data, offs)):
                docs.append((doc_ids[lo + i], ids))
                held += len(ids)
                if len(docs) >= group or held >= group_tokens:
                    yield flush()
    if docs:
        yield flush()


def pack(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE, group: int = GROUP, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece of a document in a packed sequence (``PIECE_SCHEMA``).

    ``vocabulary`` is the path of a tokenizer file that every executor can read. Rows are dealt
    round robin, so a repeated row or a hot source spreads evenly; Spark orders them before
    dealing, so that a retried task deals alike. A null or empty text is the end mark alone. A
    repeated row is packed each time, an empty table gives an empty one. A group ends with
    ``group`` documents or ``group_tokens`` tokens, whichever comes first. Sequence ids are
    unique, not dense. Other columns are ignored.
    """
    spark = docs.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartition(width)
    return dealt.mapInArrow(lambda batches: _packed(batches, vocabulary, capacity, group, group_tokens), PIECE_SCHEMA)
