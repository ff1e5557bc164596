"""Language identification by prediction by partial matching.

Each language has a context tree of byte contexts up to ``ORDER`` bytes, counted once from a
sample and then frozen. The cost of a byte is read from its longest context: where the byte
was seen there, log2((n + q) / c) bits for c of n occurrences and q distinct followers; where
it was not, the escape costs log2((n + q) / q) bits and the next shorter context decides; a
context never seen costs nothing; below the empty context every byte costs 8 bits. A text goes
to the language with the shortest code.

Because statistics are frozen, what a byte costs after a context is a number known in advance,
for all languages at once. The trees are therefore kept as hash tables from (context, byte) to a
row of costs, and a slice of text is scored by a few table look-ups on whole arrays.

Texts are scored on folded bytes: lower case, with every run of other than letters as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text_bytes import NOT_LETTER, Table, lower, slices

ORDER = 4
TRAIN_BYTES = 3_000_000
UNDETERMINED = "und"


def folded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes, each text after ``ORDER`` spaces, and where each text begins and ends in them."""
    plain = np.where(NOT_LETTER[data], np.uint8(0x20), lower(data))
    if len(data):
        keep = np.ones(len(data), bool)
        keep[1:] = (plain[1:] != 0x20) | (plain[:-1] != 0x20)
        sizes = np.concatenate(([0], np.cumsum(keep)))[offs]
        plain = plain[keep]
    else:
        sizes = offs
    out = np.full(len(plain) + ORDER * (len(offs) - 1), 0x20, np.uint8)
    each = np.diff(sizes)
    out[np.arange(len(plain)) + ORDER * np.repeat(np.arange(1, len(offs)), each)] = plain
    return out, sizes + ORDER * np.arange(len(offs))


def _grams(text: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The ``width`` bytes that end with each position, as one number."""
    key = np.zeros(len(at), np.uint64)
    for back in range(width - 1, -1, -1):
        key = (key << np.uint64(8)) | text[at - back]
    return key


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lo, hi, data, offs in slices(batch.column(1)):
            text, ends = folded(data, offs)
            at = np.arange(len(text))
            # `ends` are the starts of the padded texts; a position belongs to the text before it
            doc = np.searchsorted(ends, at, "right") - 1
            real = at - ends[doc] >= ORDER
            at, doc = at[real], doc[real]
            for lang in np.unique(langs[lo:hi].astype(str)):
                mine = at[(langs[lo:hi] == lang)[doc]]
                for width in range(1, ORDER + 2):
                    keys, n = np.unique(_grams(text, width, mine), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), width, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "width", "gram", "n"],
                    )


def _fold_of(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def held_out(docs: DataFrame):
    return F.coalesce(_fold_of(5) == 0, F.lit(False))


class Model:
    """Costs of all (context, byte) pairs for all languages."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.langs, many = langs, len(langs)
        self.tables: list[Table] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[Table] = []
        self.escapes: list[np.ndarray] = []
        for width in range(1, ORDER + 2):
            lang, gram, n = counts[width]
            keys, row = np.unique(gram, return_inverse=True)
            c = np.zeros((len(keys), many))
            np.add.at(c, (row, lang), n)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), many)), np.zeros((len(contexts), many))
            np.add.at(total, of, c)
            np.add.at(distinct, of, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
                seen = np.log2((total + distinct)[of] / c)
            shorter = self._shorter(keys & np.uint64((1 << (8 * (width - 1))) - 1), width - 1)
            self.costs.append(np.where(c > 0, seen, escape[of] + shorter).astype(np.float32))
            self.tables.append(Table(keys))
            self.contexts.append(Table(contexts))
            self.escapes.append(escape.astype(np.float32))

    def _shorter(self, keys: np.ndarray, width: int) -> np.ndarray:
        if not width:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        return self._cost(keys, width)

    def _cost(self, keys: np.ndarray, width: int) -> np.ndarray:
        row = self.tables[width - 1].find(keys)
        out = self.costs[width - 1][row]
        new = np.flatnonzero(row < 0)
        if len(new):
            context = self.contexts[width - 1].find(keys[new] >> np.uint64(8))
            escape = np.where((context >= 0)[:, None], self.escapes[width - 1][context], np.float32(0))
            out[new] = escape + self._shorter(keys[new] & np.uint64((1 << (8 * (width - 1))) - 1), width - 1)
        return out

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text of a slice in each language."""
        text, starts = folded(data, offs)
        out = np.zeros((len(offs) - 1, len(self.langs)))
        at = np.arange(ORDER, len(text))
        cost = np.zeros((len(text) + 1, len(self.langs)), np.float32)
        cost[ORDER:-1] = self._cost(_grams(text, ORDER + 1, at), ORDER + 1)
        begin, full = starts[:-1] + ORDER, np.diff(starts) > ORDER
        if full.any():
            edges = np.column_stack((begin, starts[1:])).ravel()
            out[:] = np.add.reduceat(cost, edges, axis=0, dtype=np.float64)[::2]
            out[~full] = 0.0
        return out


def fit(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model:
    """Count the context trees of every language in ``lang``.

    The sample is bounded: of each language, whole texts of about ``train_bytes`` bytes together,
    chosen by a hash of the text. Rows with a null language or text and held-out rows are not read.
    """
    labelled = docs.where(~held_out(docs) & F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["size"] for r in labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    if not sizes:
        return Model([], {w: (np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int)) for w in range(1, ORDER + 2)})
    share = F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0, train_bytes / size))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.where(draw < F.element_at(share, F.col("lang")))
    counts = sample.mapInArrow(_counted, "lang string, width int, gram long, n long").groupBy("lang", "width", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    number = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    width, gram, n = counts["width"].to_numpy(), counts["gram"].to_numpy(np.int64).astype(np.uint64), counts["n"].to_numpy(int)
    return Model(langs, {w: (number[width == w], gram[width == w], n[width == w]) for w in range(1, ORDER + 2)})


def has_letter(text: bytes) -> bool:
    return any(ch.isalpha() for ch in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    ``score`` is the share of the winner when each language weighs 2 ** -(code length); of equal
    code lengths the alphabetically first language wins. A null text, one without any letter, or any
    text when no language was learned, is ``und`` with score 0. Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            pred, share = [], []
            for _, _, data, offs in slices(batch.column(place)):
                ascii_letters = np.concatenate(([0], np.cumsum(~NOT_LETTER[data] & (data < 0x80))))[offs]
                some, high = np.diff(ascii_letters) > 0, np.diff(offs) > 0
                for i in np.flatnonzero(~some & high).tolist():
                    some[i] = has_letter(data[offs[i] : offs[i + 1]].tobytes())
                if not known.langs:
                    some[:] = False
                    best, sure = np.zeros(len(some), int), np.zeros(len(some))
                else:
                    bits = known.bits(data, offs)
                    best = bits.argmin(axis=1)
                    sure = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                pred += [known.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
                share.append(np.where(some, sure, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(np.concatenate(share) if share else np.zeros(0), pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    kept = docs.select(*[f"`{c}`" for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(score, f"{schema}, lang_pred string, score double")
