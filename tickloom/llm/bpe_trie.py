"""BPE encoding and decoding of whole texts by a trie of words.

A text falls into words (``Words``) whose ids do not depend on each other. The distinct new words of a slice of
text are put into a trie of bytes, and a depth-first walk gives every node the *last token* of the encoding of its
prefix. A prefix's last token follows from the states above it: it is the token t that ends there for which
(last token before t, t) is a pair that the merge rules leave apart. An encoding is the merge rules' own exactly
when all its neighbouring tokens are such pairs, so there is one such t, prefixes shared by many words are encoded
once, and a word's ids are read by following last tokens upwards. The end of a word is a symbol of its own.

No shuffle: each task keeps a trie and a table of words of bounded size; a full one is emptied and filled anew.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tickloom.llm.text_bytes import Hasher, lower, slices, words

CACHE_WORDS = 600_000
TRIE_NODES = 300_000
PAIRS = 500_000
LONG_WORD = 4096  # bytes; a longer word shares no prefix worth keeping and is walked outside the trie
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeRules:
    """A vocabulary file with word-end symbols: bytes and end mark of each token, and which tokens stay apart."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("dropout") or spec.get("decoder"):
            raise ValueError("a BPE vocabulary with word ends, without dropout or decoder is needed")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + END] for s in symbols]
        self.parts: dict[int, tuple[int, ...]] = {i: (i,) for i in (*self.inner, *self.final)}
        spelled = {i: (bytes([b]), False) for b, i in enumerate(self.inner)} | {i: (bytes([b]), True) for b, i in enumerate(self.final)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, new = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((a, b), (rank, new))
            if new not in spelled:
                spelled[new] = (spelled[a][0] + spelled[b][0], spelled[b][1])
                self.parts[new] = self.parts[a] + self.parts[b]
        self.inside = {s: i for i, (s, end) in spelled.items() if not end}
        self.ending = {s: i for i, (s, end) in spelled.items() if end}
        self.longest = max(len(s) for s, _ in spelled.values())
        self.apart: dict[int, bool] = {}

    def merged(self, ids: Sequence[int]) -> list[int]:
        """The merge rules applied one by one: the lowest rank first, the leftmost of equals."""
        ids = list(ids)
        while True:
            best = None
            for k in range(len(ids) - 1):
                rule = self.merges.get((ids[k], ids[k + 1]))
                if rule is not None and (best is None or rule[0] < best[0]):
                    best = (rule[0], k, rule[1])
            if best is None:
                return ids
            ids[best[1] : best[1] + 2] = [best[2]]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merge rules leave token ``b`` after token ``a`` (-1: at the start of a word) as they are."""
        key = (a + 1 << 32) | b
        found = self.apart.get(key)
        if found is None:
            found = self.merged(self.parts[b]) == [b] if a < 0 else self.merged(self.parts[a] + self.parts[b]) == [a, b]
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            self.apart[key] = found
        return found


class PrefixTrie:
    """Trie of words; node 0 is the empty prefix. ``last`` holds a prefix's last token, ``before`` the node it starts after."""

    def __init__(self, rules: MergeRules) -> None:
        self.rules = rules
        self._empty()

    def _empty(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.before = [-1], [0]

    def encode(self, batch: list[bytes]) -> list[list[int]]:
        """Ids of each word; the words come in ascending order, so their order is that of a depth-first walk."""
        if len(self.last) > TRIE_NODES:
            self._empty()
        child, last, before, rules = self.child, self.last, self.before, self.rules
        out, path, previous = [], [0], b""
        for word in batch:
            if len(word) > LONG_WORD:
                out.append(self._alone(word))
                continue
            inner = len(word) - 1
            shared = 0
            most = min(inner, len(previous), len(path) - 1)
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del path[shared + 1 :]
            for k in range(shared, inner):
                slot = path[k] << 8 | word[k]
                node = child.get(slot)
                if node is None:
                    node = len(last)
                    child[slot] = node
                    start, token = self._token_to(word, k + 1, path, rules.inside)
                    last.append(token)
                    before.append(path[start])
                path.append(node)
            previous = word
            start, token = self._token_to(word, inner + 1, path, rules.ending)
            ids, node = [token], path[start]
            while node:
                ids.append(last[node])
                node = before[node]
            ids.reverse()
            out.append(ids)
        return out

    def _alone(self, word: bytes) -> list[int]:
        """The same walk along one word, whose nodes are its places."""
        last, before = array("i", [-1]), array("i", [0])
        for end in range(1, len(word) + 1):
            start, token = self._token_to(word, end, range(end), self.rules.inside if end < len(word) else self.rules.ending, last)
            last.append(token)
            before.append(start)
        ids, node = [], len(word)
        while node:
            ids.append(last[node])
            node = before[node]
        return ids[::-1]

    def _token_to(self, word: bytes, end: int, path: Sequence[int], tokens: dict[bytes, int], last: Sequence[int] | None = None) -> tuple[int, int]:
        """Start and id of the last token of ``word[:end]``."""
        last, stay_apart = self.last if last is None else last, self.rules.stay_apart
        for start in range(max(0, end - self.rules.longest), end):
            token = tokens.get(word[start:end])
            if token is not None and stay_apart(last[path[start]], token):
                return start, token
        raise AssertionError("single bytes are tokens")


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are letters (of ASCII or Latin-1, all their bytes), which are ASCII digits, which are ASCII signs."""
    letter = ((data >= 0x61) & (data <= 0x7A)) | ((data >= 0x41) & (data <= 0x5A))
    if len(data) > 1:
        two = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[:-1] |= two
        letter[1:] |= two
    digit = (data >= 0x30) & (data <= 0x39)
    sign = (data > 0x20) & (data < 0x7F) & ~letter & ~digit
    return letter, digit, sign


class Words:
    """Ids of whole texts from the ids of their words.

    Special tokens are cut out first, as written. Else words end at ASCII white space, and also where the
    vocabulary's own splitting always has an edge: between a letter and a sign after it, and on both sides of an
    ASCII digit that has ASCII beside it. A word of letters only, of signs only or of one digit is one piece; any other word goes
    through the vocabulary file's normaliser and splitter, and its pieces through the trie.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.rules, self.hasher = MergeRules(path), Hasher()
        self.trie, tokenizer = PrefixTrie(self.rules), Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.bytes_of = {s: b for b, s in enumerate(byte_symbols())}
        self.special = [(s.encode(), i) for s, i in self.rules.special.items()]
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.sizes, self.begins = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the n + 1 offsets of the texts in them."""
        data = lower(raw)
        letter, digit, sign = _marks(data)
        breaks = np.zeros(len(data), bool)
        low = data < 0x80
        breaks[1:] = (letter[:-1] & sign[1:]) | (digit[:-1] & low[1:]) | (digit[1:] & low[:-1])
        special: dict[int, int] = {}
        text = raw.tobytes()
        if any(s in text for s, _ in self.special):
            special = self._special(text, offs)
            for at, (_, size) in special.items():
                breaks[at + 1 : at + size] = False
                breaks[at] = True
                if at + size < len(breaks):
                    breaks[at + size] = True
        starts, ends, at = words(data, offs, breaks=breaks)
        if not len(starts):
            return np.zeros(0, np.int32), at
        hashes = self.hasher.ranges(data, starts, ends)
        if special:
            rows = np.searchsorted(starts, np.fromiter(special, np.int64, len(special)))
            hashes[rows] = ~hashes[rows]  # not the word of the same letters
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._missing(distinct)
        if len(new) and len(self.keys) + len(new) > CACHE_WORDS:
            self._empty()
            new = np.arange(len(distinct))
        if len(new):
            rows = first[new]
            plain = np.zeros(len(rows), bool)
            for kind in (letter, sign):
                other = np.concatenate(([0], np.cumsum(~kind)))
                plain |= other[ends[rows]] == other[starts[rows]]
            plain |= digit[starts[rows]] & (ends[rows] - starts[rows] == 1)
            folded = data.tobytes()
            self._learn(distinct[new], [
                (special[a][0],) if a in special else folded[a:b] if easy else text[a:b].decode("utf-8", "replace")
                for a, b, easy in zip(starts[rows].tolist(), ends[rows].tolist(), plain.tolist(), strict=True)
            ])
        spot = np.searchsorted(self.keys, distinct)[inverse]
        sizes = self.sizes[spot]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return self.ids[np.repeat(self.begins[spot] - upto[:-1], sizes) + np.arange(upto[-1])], upto[at]

    def _special(self, text: bytes, offs: np.ndarray) -> dict[int, tuple[int, int]]:
        """Place of each special token as written: its id and size, from left to right and within one text."""
        found, at, edges = {}, 0, set(offs.tolist())
        while True:
            spots = [(p, -len(s), i) for s, i in self.special if (p := text.find(s, at)) >= 0]
            if not spots:
                return found
            p, size, i = min(spots)
            if edges.isdisjoint(range(p + 1, p - size)):
                found[p], at = (i, -size), p - size
            else:
                at = p + 1

    def _missing(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(distinct))
        where = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        return np.flatnonzero(self.keys[where] != distinct)

    def _learn(self, keys: np.ndarray, fresh: list[bytes | str | tuple[int]]) -> None:
        """``fresh``: a piece, a word that is to be split, or the id of a special token."""
        pieces = [[w] if isinstance(w, bytes) else [] if isinstance(w, tuple) else self._pieces(w) for w in fresh]
        order = sorted({p for own in pieces for p in own})
        known = dict(zip(order, self.trie.encode(order), strict=True))
        ids = [list(w) if isinstance(w, tuple) else [i for p in own for i in known[p]] for w, own in zip(fresh, pieces, strict=True)]
        sizes = np.array([len(x) for x in ids], np.int64)
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.sizes = np.concatenate((self.sizes, sizes))[order]
        self.begins = np.concatenate((self.begins, begins))[order]
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))))

    def _pieces(self, word: str) -> list[bytes]:
        split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word))
        return [bytes(self.bytes_of[c] for c in piece) for piece, _ in split if piece]


class Strings:
    """Texts of ids: the tokens' own strings joined by spaces, ids without a token left out."""

    def __init__(self, rules: MergeRules) -> None:
        top = max(rules.strings) + 2  # the last row stands for ids without a token
        rows = [(rules.strings[i] + " ").encode() if i in rules.strings else b"" for i in range(top)]
        self.data = np.frombuffer(b"".join(rows), np.uint8)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        ids = np.where((ids < 0) | (ids >= len(self.sizes)), len(self.sizes) - 1, ids)
        sizes = self.sizes[ids]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        data = self.data[np.repeat(self.begins[ids] - upto[:-1], sizes) + np.arange(upto[-1])]
        edges = upto[offs]
        some = np.flatnonzero(edges[1:] > edges[:-1])  # these texts end with a space too many
        keep = np.ones(len(data), bool)
        keep[edges[1:][some] - 1] = False
        fewer = np.zeros(len(edges), np.int64)
        fewer[some + 1] = 1
        edges = edges - np.cumsum(fewer)
        return pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[keep])])


def _replaced(batch: pa.RecordBatch, keep: Sequence[str], lo: int, hi: int, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [batch.column(batch.schema.get_field_index(k)).slice(lo, hi - lo) for k in keep]
    return pa.RecordBatch.from_arrays([*kept, *new.values()], names=[*keep, *new])


def _schema(df: DataFrame, keep: Sequence[str] | None, new: dict) -> tuple[list[str], StructType]:
    keep = [k for k in (df.columns if keep is None else keep) if k not in new]
    schema = StructType([df.schema[k] for k in keep])
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return keep, schema


def encode(
    docs: DataFrame, vocabulary: str, text: str = "text", into: str = "ids", keep: Sequence[str] | None = None, decoded: str | None = None
) -> DataFrame:
    """``docs`` with ``into``, the ids (array of int) of each whole text, as the vocabulary's library gives them without added tokens.

    ``vocabulary`` is the path of a file that every executor can read. ``keep`` names the columns that stay (all by default);
    a column that is called ``into`` is replaced. ``decoded`` names a further column with what ``decode`` makes of the ids, so that both
    take one pass. A null or empty text has no ids. Rows stay as they are: repeated rows
    are encoded each, order and ties do not matter, an empty table gives an empty table.
    """
    keep, schema = _schema(docs, keep, {into: ArrayType(IntegerType())} | ({decoded: StringType()} if decoded else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Words(vocabulary)
        strings = Strings(encoder.rules) if decoded else None
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(batch.schema.get_field_index("__text"))):
                ids, upto = encoder.encode(data, offs)
                new = {into: pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))}
                yield _replaced(batch, keep, lo, hi, new | ({decoded: strings.decode(ids, upto).cast(pa.string())} if strings else {}))

    return docs.select(*keep, F.col(text).cast(StringType()).alias("__text")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", into: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``rows`` with ``into``, the text of each array of ids: the tokens' strings joined by spaces, special tokens included.

    ``keep`` and ``into`` are as in ``encode``. A null or empty array has the empty text; null ids and ids that the
    vocabulary does not have are left out.
    """
    keep, schema = _schema(rows, keep, {into: StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Strings(MergeRules(vocabulary))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__ids")).fill_null([])
            for lo, hi, values, offs in _list_slices(column):
                yield _replaced(batch, keep, lo, hi, {into: strings.decode(values, offs).cast(pa.string())})

    return rows.select(*keep, F.col(ids).cast(ArrayType(IntegerType())).alias("__ids")).mapInArrow(run, schema)


def _list_slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` ids: first row, row after the last, ids (-1 for null), offsets."""
    if not len(column):
        return
    offs = column.offsets.to_numpy()
    lo, n = 0, len(column)
    while lo < n:
        hi = min(max(int(np.searchsorted(offs, offs[lo] + most, "right")) - 1, lo + 1), n)
        values = column.values.slice(offs[lo], offs[hi] - offs[lo]).fill_null(-1).to_numpy(zero_copy_only=False)
        yield lo, hi, values, offs[lo : hi + 1] - offs[lo]
        lo = hi
