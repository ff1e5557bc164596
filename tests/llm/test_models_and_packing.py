"""Toxicity, language identification and packing."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import language_id, packing, toxicity
from tickloom.llm.text_bytes import Hasher, Table, slices, words

scores = st.lists(st.sampled_from([-3.0, -1.0, -0.5, 0.5, 1.0, 2.0]), max_size=25)


def brute_segments(s):
    """Best run first (the shortest, then leftmost of equals), then what is left and right of it."""
    best = None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            t = sum(s[i:j])
            if t > 0 and (best is None or (t, i - j) > (best[0], best[1] - best[2])):
                best = (t, i, j)
    if best is None:
        return []
    t, i, j = best
    return brute_segments(s[:i]) + [(i, j, t)] + [(a + j, b + j, u) for a, b, u in brute_segments(s[j:])]


@settings(max_examples=200, deadline=None)
@given(scores)
def test_maximal_segments(s):
    assert toxicity.maximal_segments(s) == brute_segments(s)


@pytest.mark.parametrize("gap", [-3.0, -0.25])
def test_maximal_segments_of_very_many_hits(gap):
    """Isolated hits with a falling, and joined hits with a rising sum: a scan that looks back at all of them would not end."""
    n = 300_000
    found = toxicity.maximal_segments([1.0, gap] * n)
    assert found == ([(2 * i, 2 * i + 1, 1.0) for i in range(n)] if gap < -1 else [(0, 2 * n - 1, 1.0 + 0.75 * (n - 1))])


def labelled_docs(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(f"w{(i * 7 + k * k) % 97}a" for k in range(60)).replace("0", "o").replace("1", "i")
        if bad:
            text = text[:100] + " vileword nastything vilewords " + text[100:]
        rows.append((i, "".join(c for c in text if not c.isdigit()), "en"))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, 1, None), (7777, 0, 1), (0, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_spans(spark):
    docs, labels = labelled_docs(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 600
    assert all(r.predicted == int(r.doc_id % 4 == 0) == int(r.score >= toxicity.REJECT) for r in got)
    for r in got:
        if r.predicted:
            assert any("nastything" in r.text[s.start : s.end] for s in r.segments)


def test_toxicity_odd_rows(spark, odd, odd_rows, empty):
    docs, labels = labelled_docs(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(empty, model).count() == 0
    # no labels, or one class only: everything gets the same low score
    none = toxicity.fit(docs, labels.where("doc_id < -1"))
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    for m in (none, one):
        assert {r.predicted for r in toxicity.score(docs, m).collect()} == {0}


class Tree:
    """The same model, one byte at a time."""

    def __init__(self, texts):
        self.counts = {}
        for t in texts:
            for i in range(len(t)):
                for k in range(language_id.ORDER + 1):
                    context = ((" " * language_id.ORDER).encode() + t)[i + language_id.ORDER - k : i + language_id.ORDER]
                    self.counts.setdefault(context, {}).setdefault(t[i], 0)
                    self.counts[context][t[i]] += 1

    def bits(self, t):
        total, padded = 0.0, (" " * language_id.ORDER).encode() + t
        for i in range(len(t)):
            for k in range(language_id.ORDER, -1, -1):
                seen = self.counts.get(padded[i + language_id.ORDER - k : i + language_id.ORDER], {})
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if t[i] in seen:
                    total += math.log2((n + q) / seen[t[i]])
                    break
                total += math.log2((n + q) / q)
            else:
                total += 8
        return total


def fold(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return language_id.folded(data, np.array([0, len(data)]))[0].tobytes()[language_id.ORDER :]


def lang_docs(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and then it sleeps", "le renard brun saute par dessus le chien et puis il dort très bien"
    rows = [(i, " ".join((en if i % 2 else fr).split()[k % 13] for k in range(i % 11, i % 11 + 9)), "en" if i % 2 else "fr") for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_code_lengths_equal_plain_trees(spark):
    docs = lang_docs(spark)
    model = language_id.fit(docs)
    train = docs.where(~language_id.held_out(docs)).collect()
    trees = {x: Tree([fold(r.text) for r in train if r.lang == x]) for x in model.langs}
    for text in ("the dog sleeps", "le chien dort", "Zwölf Boxkämpfer!!  jagen", "x", "THE  DOG"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = model.bits(data, np.array([0, len(data)]))[0]
        assert got == pytest.approx([trees[x].bits(fold(text)) for x in model.langs], rel=1e-4)


def test_language_held_out_and_odd_rows(spark, odd, odd_rows, empty):
    docs = lang_docs(spark)
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in got)
    odd_got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert {odd_got[i].lang_pred for i in (2, 3, 4, 10)} == {"und"} and odd_got[2].score == 0
    assert odd_got[11].lang_pred in model.langs
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=40))
def test_pack_group_is_a_partition(lengths):
    pieces = packing.pack_group(lengths)
    for d, n in enumerate(lengths):
        at = 0
        for _, start, size, _, _ in sorted(p for p in pieces if p[0] == d):
            assert start == at and size > 0
            at += size
        assert at == n
    by = {}
    for _, _, size, sequence, offset in pieces:
        by.setdefault(sequence, []).append((offset, size))
    padded = 0
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= packing.SEQUENCE
        padded += 0 if at & (at - 1) == 0 else packing.SEQUENCE - at
    assert padded <= len(by) * packing.SEQUENCE // 16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_tournament_tree_is_first_fit(lengths):
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = b
        free[b] -= lengths[i]
    assert [b for b, _ in packing.first_fit_decreasing(lengths, 100)] == [want[i] for i in range(len(lengths))]


def test_packed_ids_equal_the_tokenizer(spark, odd, odd_rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(vocabulary)
    got = packing.pack(odd, vocabulary, group=3).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, packing.END_OF_TEXT]
        want.append((doc_id, len(ids), ids))
    for doc_id, n, ids in want:
        mine = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == doc_id and r.doc_tokens == n})
        assert mine and all(crc(ids[s : s + k]) == c for s, k, c, _ in mine)
    assert sum(r.length for r in got) == sum(n for _, n, _ in want)
    assert packing.pack(empty, vocabulary).count() == 0


def test_groups_end_by_tokens_too(spark):
    """A group of few tokens is packed by itself: sequences of one group only, every id once."""
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, "ab cd " * (5 + i % 7)) for i in range(60)], "doc_id long, text string").coalesce(1)
    whole = packing.pack(docs, vocabulary).collect()
    parts = packing.pack(docs, vocabulary, group_tokens=100).collect()
    for rows in (whole, parts):  # a document may be cut, and each of its ids is in one piece
        for i in range(60):
            mine = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
            assert [s for s, *_ in mine] == [sum(n for _, n, _ in mine[:k]) for k in range(len(mine))] and sum(n for _, n, _ in mine) == mine[0][2]
    tokens = {}
    for r in parts:
        tokens[r.sequence_id] = tokens.get(r.sequence_id, 0) + r.length
    longest = max(r.doc_tokens for r in parts)
    assert max(tokens.values()) <= 100 + longest < sum(tokens.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab,.é <|\n\u00a0Z'1", max_size=30), min_size=1, max_size=6))
def test_words_are_encoded_as_whole_texts(texts):
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    mine = WORDS.setdefault("t", packing.WordTokenizer(vocabulary))
    data = "".join(texts).encode()
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    got = mine.encode(np.frombuffer(data, np.uint8), offs)
    assert [g.tolist() for g in got] == [[*mine.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


WORDS = {}


def test_byte_helpers():
    column = pa.array(["ab cd", None, "", "x  y", "é"]).slice(0, 5)
    found = []
    for lo, hi, data, offs in slices(column, 4):
        starts, ends, at = words(data, offs)
        found += [[bytes(data[a:b]) for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(at[:-1], at[1:], strict=True)]
        assert hi > lo
    assert found == [[b"ab", b"cd"], [], [], [b"x", b"y"], ["é".encode()]]
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    table = Table(keys[::2])
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (table.find(keys[1::2]) == -1).all()
    data = np.frombuffer(b"abcabc", np.uint8)
    h = Hasher().ranges(data, np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]
